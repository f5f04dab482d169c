"""Documents from files, folders and archives: one row for each document, readable or not."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_id string, text string, error string"
#: Folders are searched for these; a path that names a file is read whatever its ending.
READ_IN_FOLDERS = r"(?i)\.(csv|txt|json)$"
IN_FOLDERS = "*.{[cC][sS][vV],[tT][xX][tT],[jJ][sS][oO][nN]}"


def members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The documents in a file's bytes: an archive's members by `archive/member`, else the file itself."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in archive.namelist():
                if not name.endswith("/"):
                    yield f"{path}/{name}", archive.read(name)
    elif path.endswith((".tar", ".tar.gz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            for member in archive:
                if member.isfile():
                    yield f"{path}/{member.name}", archive.extractfile(member).read()
    elif path.endswith(".gz"):
        yield path, gzip.decompress(data)
    elif path.endswith(".bz2"):
        yield path, bz2.decompress(data)
    else:
        yield path, data


def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            try:
                for name, content in members(path, data):
                    try:
                        rows.append((name, content.decode("utf-8"), None))
                    except UnicodeDecodeError as error:
                        rows.append((name, None, str(error)))
            except Exception as error:  # one bad archive leaves the others alone
                rows.append((path, None, f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(rows, columns=["file_id", "text", "error"])


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """file_id, text and error of all documents under the paths.

    A path (or a pattern of paths) is a file, an archive (.zip, .tar, .tar.gz, .tar.bz2), a compressed file (.gz, .bz2)
    or a folder, which is searched to any depth for .csv, .txt and .json files. What can't be read has an error and no
    text; so has a path that leads nowhere. All files are one scan and all folders another, however many paths there are,
    and files of other endings are not opened.
    """
    files, folders, nowhere = [], [], []
    conf, place = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path
    for path in dict.fromkeys(paths):
        at = place(path)
        found = at.getFileSystem(conf).globStatus(at)
        for status in found or ():
            (folders if status.isDirectory() else files).append(status.getPath().toString())
        if not found:
            nowhere.append((path, None, "Unknown file source."))
    out = spark.createDataFrame(nowhere, SCHEMA)
    if files:
        out = out.unionByName(spark.read.format("binaryFile").load([_literal(f) for f in dict.fromkeys(files)]).select("path", "content").mapInPandas(opened, SCHEMA))
    if folders:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IN_FOLDERS).load([_literal(f) for f in dict.fromkeys(folders)])
        out = out.unionByName(found.select("path", "content").mapInPandas(opened, SCHEMA))
    return out


def _literal(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def from_dicts(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    """file_id, text and error of documents that are at hand as dicts, as they would stand in JSON files."""
    return spark.createDataFrame([(name, json.dumps(body), None) for name, body in documents.items()], SCHEMA)


def from_texts(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(name, text, None) for name, text in documents.items()], SCHEMA)


def read_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """file_id and id of the ids in JSON files that hold lists of them; what is no string is left out."""
    return spark.createDataFrame([], "file_id string, id string").unionByName(
        read_documents(spark, *paths).select("file_id", F.explode(F.from_json("text", "array<string>")).alias("id")).filter("id IS NOT NULL")
    )


def read_lines(documents: DataFrame) -> DataFrame:
    """file_id, line_no and line of the lines that are not empty."""
    from assayspark.operators.parse_text import lines

    return lines(documents.filter("error IS NULL"))
