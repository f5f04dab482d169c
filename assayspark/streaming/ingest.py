"""Documents as they arrive in a folder, as tables that grow batch by batch."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayspark.model import Tables
from assayspark.operators.read import to_tables
from assayspark.sources.files import READ_IN_FOLDERS, SCHEMA, opened

FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts to read new .csv, .txt and .json files of the folder; ends when all that are there are read.

    Each batch is written to a folder of its own in each table, so a batch that is run again after a failure replaces
    what it wrote before. Call it again with the same checkpoint for what has come since.
    """
    found = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    documents = found.filter(F.col("path").rlike(READ_IN_FOLDERS)).select("path", "content").mapInPandas(opened, SCHEMA)

    def write(batch: DataFrame, number: int) -> None:
        tables = to_tables(batch.persist())
        for f in fields(Tables):
            getattr(tables, f.name).write.mode("overwrite").parquet(f"{out}/{f.name}/batch={number}")
        batch.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, out: str) -> Tables:
    """All tables that ingest() has written."""
    return Tables(*(spark.read.option("basePath", f"{out}/{f.name}").parquet(f"{out}/{f.name}").drop("batch") for f in fields(Tables)))
