"""What several operators use: the shared scratch folder, written tables, and reading texts in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from assayspark.model import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables that one run writes to the shared folder and reads back: what follows reads files, which outlive lost
    executors. drop() takes away those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.folder}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    return Scratch(df.sparkSession).keep(df, name)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings hold about `most` bytes (one row at least), so memory follows the texts."""
    strings = batch.column(column)
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(strings).to_pylist()):
        if held and held + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Applies `work`, which gives the new columns of a run of rows, to all of df inside Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, column):
                out = work(rows)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(batches, schema)
