"""The normalised tables that a collection of documents becomes, and the format's fixed names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: The format's own marker and names, with the two-letter codes of its item lines. Fixed values.
MARKER = "#METABOLOMICS WORKBENCH"
HEADER = "METABOLOMICS WORKBENCH"
PREFIXES = {
    "METABOLOMICS WORKBENCH": "", "PROJECT": "PR:", "STUDY": "ST:", "SUBJECT": "SU:", "SUBJECT_SAMPLE_FACTORS": "", "COLLECTION": "CO:", "TREATMENT": "TR:",
    "SAMPLEPREP": "SP:", "CHROMATOGRAPHY": "CH:", "ANALYSIS": "AN:", "MS": "MS:", "NM": "NM:",
    "MS_METABOLITE_DATA": "", "NMR_METABOLITE_DATA": "", "NMR_BINNED_DATA": "", "METABOLITES": "",
}
DATA_SECTIONS = ("MS_METABOLITE_DATA", "NMR_METABOLITE_DATA", "NMR_BINNED_DATA")
TABLES = ("Data", "Metabolites", "Extended")

PAIRS = "array<struct<key:string,value:string,dup:int>>"


@dataclass
class Tables:
    """One row for each document, item, sample, column, cell and so on; file_id names the document everywhere.

    files:    file_id, input_format (text, json or null), data_section, error
    items:    file_id, section, ord, key, value, repeated (an equal value was given again), raw (no string: the value is JSON text)
    ssf:      file_id, idx, subject_id, sample_id, factors, additional (both PAIRS; dup counts repeats of a key from 0)
    headers:  file_id, tbl, pos, raw, column, dup, named (false: cells beyond the header)
    cells:    file_id, tbl, row, pos (of the column in the table), at (in the row), column, dup, value, raw (as in items)
    factors:  file_id, sample_id, ord, key, value      the factors that a data table repeats
    blocks:   file_id, section, tbl, overflow (a row is longer than the header)
    results:  file_id, section, filename, units, has_mz, has_rt, rt_units

    Beside them, where documents were read as text (else None; lost where tables are replaced or cells are written):
    grids:    file_id, tbl, names, dups, values      tables of one block without overflow: the columns, and the values of each row, one for each column
    others:   as cells, those that are in no grid

    and where they were read as JSON (lost likewise):
    lists:    file_id, tbl, names, rows (row and cells: pos, value, raw)      tables that stand in one section
    loose:    as cells, those that are in neither a grid nor a list
    """

    files: DataFrame
    items: DataFrame
    ssf: DataFrame
    headers: DataFrame
    cells: DataFrame
    factors: DataFrame
    blocks: DataFrame
    results: DataFrame

    grids = others = lists = loose = None  # no fields, so that replace() drops them

    def with_grids(self, grids: DataFrame | None, others: DataFrame | None) -> Tables:
        self.grids, self.others = grids, others
        return self

    def with_lists(self, lists: DataFrame | None, loose: DataFrame | None) -> Tables:
        self.lists, self.loose = lists, loose
        return self

    def beside(self, other: Tables) -> Tables:
        """These tables with what the other has beside its own."""
        return self.with_grids(other.grids, other.others).with_lists(other.lists, other.loose)

    def union(self, other: Tables) -> Tables:
        out = Tables(*(getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)))
        one = lambda frames: reduce(DataFrame.unionByName, frames) if frames else None
        grids, lists = (one([x for x in (getattr(t, name) for t in (self, other)) if x is not None]) for name in ("grids", "lists"))
        rest = [t.cells if t.others is None else t.others for t in (self, other)]
        loose = [x if t.loose is None else t.loose for t, x in zip((self, other), rest, strict=True)]
        return out.with_grids(grids, one(rest) if grids is not None else None).with_lists(lists, one(loose) if lists is not None else None)

    def save(self, folder: str, *names: str) -> Tables:
        """Writes all tables, or those that are named, as Parquet and reads them back, so that texts are parsed once. Others stay as they are."""
        spark, out = self.files.sparkSession, []
        for f in fields(self):
            df: DataFrame = getattr(self, f.name)
            if names and f.name not in names:
                out.append(df)
                continue
            df.write.mode("overwrite").parquet(f"{folder}/{f.name}")
            out.append(spark.read.schema(df.schema).parquet(f"{folder}/{f.name}"))
        kept = Tables(*out)
        return kept.beside(self) if names and "cells" not in names else kept

    def kept(self, *names: str) -> Tables:
        """save() to a new folder of shared_folder()."""
        return self.save(f"{shared_folder(self.files.sparkSession)}/tables-{uuid.uuid4().hex}", *names)


_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Takes away at its end all that was written to the shared folder within it, by whatever operators. What they gave must have been read
    or saved by then; without a run, what they wrote stays, as their results read it."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or within run() one of the run's own there. On one machine the
    setting may be unset: then one in the warehouse."""
    if folder := _run.get():
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back, so that what several plans read is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
