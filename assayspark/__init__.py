"""assayspark: checks, extraction and conversion of study depositions as Spark plans."""

__version__ = "0.1.0"
