"""First lines of documents: read as one text, and set for many documents at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayspark.model import HEADER, MARKER, Tables

#: Items of the header section that have lines of their own.
OWN_LINES = ("VERSION", "CREATED_ON")


def headers_of(t: Tables) -> DataFrame:
    """file_id and header: the first line of every document that has items for it."""
    rows = t.items.filter((F.col("section") == HEADER) & ~F.col("key").isin(*OWN_LINES))
    words = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat("key", F.lit(":"), "value").alias("word")))), lambda x: x["word"])
    return rows.groupBy("file_id").agg(F.concat_ws(" ", F.lit(MARKER), F.array_join(words, " ")).alias("header"))


def with_headers(t: Tables, new: DataFrame) -> Tables:
    """The tables with the headers of new(file_id, header): each ` KEY:value` of a header is set in its document, further items of the
    section stay, and new keys come last. Of a key that is given twice, the last value counts; so does, of a document, the header that is last in
    order. A header that doesn't begin with the format's marker makes reading the items fail; documents that aren't there are left out."""
    good = F.when(F.col("header").startswith(MARKER), F.col("header")).otherwise(F.raise_error(F.concat(F.lit(f"A header begins with {MARKER}, not as: "), F.coalesce("header", F.lit("null")))).cast("string"))
    given = new.groupBy("file_id").agg(F.max("header").alias("header")).join(t.files.select("file_id"), "file_id", "left_semi")
    words = given.select("file_id", F.posexplode(F.regexp_extract_all(good, F.lit(r"(?U) (\w*:\w*)"), 1)).alias("pos", "word"))
    pair = words.select("file_id", "pos", F.split("word", ":")[0].alias("key"), F.split("word", ":")[1].alias("value"))
    pair = pair.groupBy("file_id", "key").agg(F.max_by("value", "pos").alias("given"), F.min("pos").alias("pos"))
    items = t.items.join(given.select("file_id"), "file_id", "left_semi").filter(F.col("section") == HEADER)
    both = items.join(pair, ["file_id", "key"], "full_outer")
    along = Window.partitionBy("file_id").orderBy(F.col("ord").asc_nulls_last(), "pos")
    both = both.select(
        "file_id", F.lit(HEADER).alias("section"), (F.row_number().over(along) - 1).alias("ord"), "key", F.coalesce("given", "value").alias("value"),
        (F.coalesce("repeated", F.lit(False)) & F.col("given").isNull()).alias("repeated"), (F.coalesce("raw", F.lit(False)) & F.col("given").isNull()).alias("raw"),
    )
    mine = t.items.join(given.select("file_id").withColumn("set", F.lit(True)), "file_id", "left")
    others = mine.filter(F.col("set").isNull() | (F.col("section") != HEADER)).drop("set")
    return replace(t, items=others.unionByName(both))
