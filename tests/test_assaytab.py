"""The data source and the table function, against the plans that parse whole collections."""

from __future__ import annotations

import json
import os
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayspark.functions.table_function import AssayRows
from assayspark.operators.read import to_tables
from assayspark.sources import assaytab as A
from assayspark.sources.files import from_texts
from tests.test_assay_documents import DOCUMENTS, RAGGED

UNREAD = ("no tab", "bad pair")  # readable in part; with an error in the table of files
ALL = {k.replace(" ", "-"): v for k, v in DOCUMENTS.items() if k not in UNREAD} | {"ragged": json.dumps({"MS_METABOLITE_DATA": {"Units": "x", "Data": RAGGED}})}


@pytest.fixture(scope="module")
def tables(spark):
    spark.dataSource.register(A.AssayTab)
    return to_tables(from_texts(spark, {f"{k}.txt": v for k, v in ALL.items()})).kept()


def rows(df, name=lambda x: x):
    return sorted((repr([name(r.file_id), *[r[c] for c in sorted(df.columns) if c != "file_id"]]) for r in df.collect()))


def written(folder):
    for name, text in ALL.items():
        at = Path(folder, "deep" if len(name) % 2 else ".", f"{name}.txt")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    return str(folder)


@pytest.mark.parametrize("table", ["items", "ssf", "cells"])
def test_tables_equal_those_of_the_plans(spark, tables, tmp_path, table):
    got = spark.read.format("assaytab").option("table", table).option("partitionbytes", 3000).load(written(tmp_path))
    want = getattr(tables, table)
    if table == "items":  # places in JSON documents count parts
        want = want.withColumn("ord", F.when(F.col("file_id").isin("json.txt", "ragged.txt"), 0).otherwise(F.col("ord")))
        got = got.withColumn("ord", F.when(F.col("file_id").endswith("json.txt") | F.col("file_id").endswith("ragged.txt"), 0).otherwise(F.col("ord")))
    assert rows(got, os.path.basename) == rows(want.select(*got.columns)) and got.rdd.getNumPartitions() > 3


def test_documents_and_filters(spark, tables, tmp_path):
    Path(tmp_path, "bad.txt").write_bytes(b"\xff\xfe")
    Path(tmp_path, "not.pdf").write_bytes(b"x")
    read = spark.read.format("assaytab")
    got = {os.path.basename(r.file_id): (r.text, r.error is None) for r in read.load(written(tmp_path)).collect()}
    assert got == {f"{k}.txt": (v, True) for k, v in ALL.items()} | {"bad.txt": (None, False)}
    reader = A.FilteredReader({"path": str(tmp_path)}, "cells", None)
    left = list(reader.pushFilters([A.EqualTo(("tbl",), "Data"), A.EqualTo(("file_id",), f"{tmp_path}/deep/7.txt"), A.EqualTo(("row",), 1)]))
    assert len(left) == 1 and reader.wanted == {"tbl": "Data", "file_id": f"{tmp_path}/deep/7.txt"} and [len(p.units) for p in reader.partitions()] == [1]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        cells = read.option("table", "cells").option("filters", "true").load(str(tmp_path))
        assert rows(cells.filter("tbl = 'Metabolites' AND row = 1"), os.path.basename) == rows(tables.cells.filter("tbl = 'Metabolites' AND row = 1").select(*cells.columns))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    items = spark.read.format("assaytab").options(table="items", section="PROJECT", file_id=f"{tmp_path}/deep/7.txt").load(str(tmp_path))
    assert rows(items, os.path.basename) == rows(tables.items.filter("section = 'PROJECT' AND file_id = '7.txt'").select(*items.columns))
    with pytest.raises(Exception, match="none of documents"):
        read.option("table", "nothing").load(str(tmp_path)).collect()


@pytest.mark.parametrize("archive", A.ARCHIVES)
def test_one_archive_for_all_documents(spark, tables, tmp_path, archive):
    """Python's own readers read it; so does the data source, by ranges in several tasks."""
    path = f"{tmp_path}/all.{archive}"
    texts = {f"n{i:04d}.txt": f"document {i} é " * (i % 50) for i in range(500)} | {"deep/" + "long" * 40 + ".txt": "x" * 200_000}
    df = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(5)
    df.write.format("assaytab").option("archive", archive).mode("overwrite").save(path)
    if archive == "zip":
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == texts
    else:
        with tarfile.open(path) as t:
            assert {m.name: t.extractfile(m).read().decode() for m in t} == texts
    assert os.listdir(tmp_path) == [f"all.{archive}"]
    got = spark.read.format("assaytab").option("partitionbytes", 20_000).load(path)
    assert {r.file_id: r.text for r in got.collect()} == {f"{path}/{k}": v for k, v in texts.items()}
    assert (got.rdd.getNumPartitions() > 3) == (archive in ("zip", "tar"))
    with pytest.raises(Exception, match="FileExists"):
        df.write.format("assaytab").option("archive", archive).mode("append").save(path)


def test_far_offsets_and_many_members_of_a_zip(tmp_path):
    """Entries beyond 4 GB and more than 65,535 of them, in a file with a hole."""
    path, far = Path(tmp_path, "far.zip"), 5_000_000_000
    with path.open("wb") as f:
        f.seek(far)
        body = b"\x03\x00"  # deflated nothing
        heads = [A._zip_head(f"m{i}".encode(), 0, 2, 0) + body for i in range(70_000)]
        entries, at = [], far
        for i, h in enumerate(heads):
            entries.append(A._zip_entry(f"m{i}".encode(), 0, 2, 0, at))
            at += len(h)
        f.write(b"".join(heads) + b"".join(entries) + A._zip_end(len(entries), sum(map(len, entries)), at))
    with zipfile.ZipFile(path) as z:
        assert len(z.namelist()) == 70_000 and z.read("m69999") == b""
    units = list(A.units_of(str(path)))
    assert len(units) == 70_000 and list(A.contents(units[-1:])) == [(f"{path}/m69999", b"")]
    assert len(A.dealt(iter(units), 1_000_000)) > 10


def test_files_are_written_whole_or_not_at_all(spark, tables, tmp_path):
    folder = f"{tmp_path}/out"
    df = spark.createDataFrame([(f"d{i % 3}/n{i}.txt", f"text {i}") for i in range(30)], "name string, text string").repartition(4)
    df.write.format("assaytab").mode("append").save(folder)
    found = {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*.txt")}
    assert found == {r.name: r.text for r in df.collect()} and os.listdir(tmp_path) == ["out"]

    bad = df.withColumn("text", F.when(F.col("name") == "d2/n29.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    clash = df.unionByName(df.limit(1))
    for rows_, archive in ((bad, ""), (bad, "zip"), (clash, ""), (df.withColumn("name", F.concat(F.lit("../"), "name")), "")):
        with pytest.raises(Exception, match="broken|Several|no name"):
            rows_.write.format("assaytab").option("archive", archive).mode("overwrite").save(f"{tmp_path}/other")
        assert os.listdir(tmp_path) == ["out"]


def test_table_function(spark, tables):
    spark.udtf.register("assay_rows", AssayRows)
    from_texts(spark, {f"{k}.txt": v for k, v in ALL.items()} | {"null": None}).withColumn("more", F.lit(1)).createOrReplaceTempView("assay_documents")
    got = spark.sql("SELECT * FROM assay_rows(TABLE(assay_documents) PARTITION BY (file_id), 'cells') WHERE tbl = 'Data'")
    assert rows(got) == rows(tables.cells.filter("tbl = 'Data'").select(*got.columns))
    with pytest.raises(Exception, match="none of items"):
        spark.sql("SELECT * FROM assay_rows(TABLE(assay_documents), 'nothing')").collect()
