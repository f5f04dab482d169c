"""Part of assayspark."""
