"""Cells beside the metabolites of their rows: found within the rows, without a join."""

import re

from assayspark.operators.extract import matchers, measurements
from assayspark.operators.parse_text import text_tables, text_values
from assayspark.plans.document_queries import documents
from tests.test_located import _TEXTS


def _joined(t):
    cells = [r for r in t.cells.collect()]
    names = [(r.file_id, r.tbl, r.row, r.value) for r in cells if r.column == "Metabolite" and r.dup == 0]
    return sorted((*n[:3], n[3], r.column, r.dup, r.value) for n in names for r in cells if n[:3] == (r.file_id, r.tbl, r.row) and (r.column, r.dup) != ("Metabolite", 0) and r.value)


def test_values_as_joined_cells(spark):
    docs = spark.createDataFrame([(k, v, None) for k, v in _TEXTS.items()], "file_id string, text string, error string")
    assert sorted(map(tuple, text_values(docs).collect())) == _joined(text_tables(docs))


def test_measurements_without_a_join_of_cells(spark):
    docs = spark.createDataFrame([(k, v, None) for k, v in _TEXTS.items()], "file_id string, text string, error string")
    found = measurements(text_tables(docs, store_tables=False), matchers([("MS:MS_TYPE", "ESI")]), lambda files: text_values(docs.join(files, "file_id", "left_semi")))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, measurements(text_tables(docs), matchers([("MS:MS_TYPE", "ESI")])).collect()))


def test_ids_of_long_keys(spark, tmp_path):
    spark.createDataFrame([(1234567, 1, "BUILDING"), (1234568, 1, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1234567), (2, 1234568)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5, 3.0, 0.1), (2, 5, 4.0, 0.1)], "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {re.search("ANALYSIS_ID:([^\n]*)", r.text)[1] for r in documents(spark, str(tmp_path)).collect()} == {"AN1234567", "AN1234568"}
