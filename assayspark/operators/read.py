"""From documents to tables, whichever form they have."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayspark.model import Tables
from assayspark.operators.parse_json import is_json, json_tables
from assayspark.operators.parse_text import is_text, text_tables
from assayspark.sources.files import read_documents


def to_tables(documents: DataFrame, force: bool = False, on_error: str = "row") -> Tables:
    """The tables of documents(file_id, text, error). Documents that can't be read are rows of files with an error; with
    on_error="raise", reading the table of files fails at the first of them."""
    blank = ~F.coalesce(F.rlike("text", F.lit(r"\S")), F.lit(False))
    known = is_text(F.col("text")) | is_json(F.col("text"))
    why = F.coalesce("error", F.when(blank, "Blank document.").otherwise("Unknown file format."))
    bad = documents.filter(F.col("error").isNotNull() | blank | ~known)
    bad = bad.select("file_id", F.lit(None).cast("string").alias("input_format"), F.lit(None).cast("string").alias("data_section"), why.alias("error"))
    good = text_tables(documents).union(json_tables(documents, force))
    files = good.files.unionByName(bad)
    if on_error == "raise":
        files = files.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file_id", F.lit(": "), "error")).cast("string")))
    return replace(good, files=files).beside(good)


def read_tables(spark: SparkSession, *paths: str, force: bool = False, on_error: str = "row") -> Tables:
    return to_tables(read_documents(spark, *paths), force, on_error)


def read_with(documents: DataFrame, read: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """What a reader of the caller's own makes of each document: file_id, error and the columns of the schema.

    read takes a text and gives rows of the schema; a text that it fails on, and a document that has an error already,
    is a row with the error and nulls. It is sent to the tasks, so it should be a plain function.
    """
    names = [f.name for f in StructType.fromDDL(schema)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, text, error in zip(batch["file_id"], batch["text"], batch["error"], strict=True):
                try:
                    out += [(file_id, error, *[None] * len(names))] if error is not None else [(file_id, None, *row) for row in read(text)]
                except Exception as fault:  # one bad document leaves the others alone
                    out.append((file_id, f"{type(fault).__name__}: {fault}", *[None] * len(names)))
            yield pd.DataFrame(out, columns=["file_id", "error", *names]).astype(object)

    return documents.select("file_id", "text", "error").mapInPandas(rows, f"file_id string, error string, {schema}")
