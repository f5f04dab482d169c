"""The table `values` of the data source and the table function: cells that are not empty, beside the metabolites of their rows."""

from assayspark.functions.one_document import rows_of
from assayspark.functions.table_function import AssayRows
from tests.test_filled import _JSON
from tests.test_located import _TEXTS


def _joined(text):
    cells = list(rows_of(text, "cells"))
    names = [(c[0], c[1], c[6]) for c in cells if c[4] == "Metabolite" and c[5] == 0]
    return sorted((*n, c[4], c[5], c[6]) for n in names for c in cells if n[:2] == c[:2] and c[4:6] != ("Metabolite", 0) and c[6])


def test_values_as_joined_cells():
    for text in (*_TEXTS.values(), _JSON):
        assert sorted(rows_of(text, "values")) == _joined(text)
    assert [r for r in rows_of(_TEXTS["twice"], "values", None, "Extended")] == [("Extended", 0, "m1", "sample_id", 0, "s1")]


def test_values_by_the_table_function(spark):
    spark.udtf.register("assay_rows", AssayRows)
    docs = spark.createDataFrame(list(_TEXTS.items()), "file_id string, text string")
    got = spark.sql("SELECT * FROM assay_rows(TABLE(SELECT * FROM {docs}), 'values')", docs=docs)
    assert sorted(map(tuple, got.collect())) == sorted((k, *row) for k, v in _TEXTS.items() for row in rows_of(v, "values"))
