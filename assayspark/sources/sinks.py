"""Documents to files, each task writing its own: single files, or an archive for each task."""

from __future__ import annotations

import bz2
import gzip
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from assayspark.operators.render import output_name
from assayspark.sources.assaytab import AssayTab

PACKERS = {"": lambda data: data, "gz": gzip.compress, "bz2": bz2.compress}
ARCHIVES = {"zip": None, "tar": "w", "tar.gz": "w:gz", "tar.bz2": "w:bz2"}


def _put(path: Path, data: bytes) -> None:
    """A whole file or none: a task that is run again replaces what it wrote."""
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(f".{path.name}.{os.getpid()}")
    new.write_bytes(data)
    new.replace(path)


def common_folder(rows: DataFrame) -> str:
    """The longest folder that all file_ids lie in, with its slash: what the first and the last of them have in common."""
    ends = rows.agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).first()
    common = os.path.commonprefix([ends["low"] or "", ends["high"] or ""])
    return common[: common.rfind("/") + 1]


def _named(texts: DataFrame, extension: str) -> DataFrame:
    """name and text of texts(file_id, text); names that clash raise an error."""
    named = texts.select(output_name(F.col("file_id"), common_folder(texts), extension).alias("name"), "text")
    clash = named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").first()
    if clash:
        raise ValueError(f"{clash['n']} documents would be written to {clash['name']}")
    return named


def write_archive(texts: DataFrame, path: str, extension: str = "txt", archive: str = "zip") -> None:
    """One archive (zip, tar, tar.gz or tar.bz2) of all rows of texts(file_id, text), named as by write_documents. Tasks write its parts; a
    job that fails leaves neither an archive nor parts."""
    texts.sparkSession.dataSource.register(AssayTab)
    _named(texts, extension).write.format("assaytab").option("archive", archive).mode("overwrite").save(path)


def write_documents(texts: DataFrame, folder: str, extension: str = "txt", compression: str = "") -> None:
    """A file for each row of texts(file_id, text), in a folder that all executors see under the same path.

    Files are named by the documents' paths below the folder that all of them have in common; names that clash raise an
    error before anything is written. compression: gz or bz2 for single files; zip, tar, tar.gz or tar.bz2 for one
    archive of each task's documents.
    """
    if compression not in PACKERS and compression not in ARCHIVES:
        raise ValueError(f"Unknown compression {compression}")
    named = _named(texts, extension)
    Path(folder).mkdir(parents=True, exist_ok=True)

    def single(rows: Iterator[Row]) -> None:
        for row in rows:
            _put(Path(folder, f"{row.name}.{compression}" if compression else row.name), PACKERS[compression](row.text.encode()))

    def archive(rows: Iterator[Row]) -> None:
        path = Path(folder, f"part-{TaskContext.get().partitionId():05d}.{compression}")
        new, first = path.with_name(f".{path.name}.{os.getpid()}"), next(rows, None)
        if first is None:
            return
        held = zipfile.ZipFile(new, "w", zipfile.ZIP_DEFLATED) if compression == "zip" else tarfile.open(new, ARCHIVES[compression])
        with held:
            while first is not None:
                data = first.text.encode()
                if compression == "zip":
                    held.writestr(first.name, data)
                else:
                    info = tarfile.TarInfo(first.name)
                    info.size = len(data)
                    held.addfile(info, io.BytesIO(data))
                first = next(rows, None)
        new.replace(path)

    named.foreachPartition(archive if compression in ARCHIVES else single)
