"""What checks look for in cells is found within a table's row, for text whose tables are one block; with the same issues as cell by cell."""

from dataclasses import replace

from assayspark.operators.read import to_tables
from assayspark.operators.validate import issues, shared
from tests.test_located import _HEAD, _TEXTS

_TABLES = [
    "MS_METABOLITE_DATA_START", "Samples\ts1\ts1\ts2\t", *(f"m{i}\t1\t{i // 10}\tNA" for i in range(11)), "m1 \t1", "m1 \t1", "m1\t1", "N/A\t1", "Samples\t2", "MS_METABOLITE_DATA_END",
    "#METABOLITES", "METABOLITES_START", "metabolite_name\tpubchem cid\tpolarity\tri\tother_id\tother_id_type", "m1\t1\tpos\t\tx\t", "m1\t1\tpos\t\tx\t", "m99\tx y\tneg\t-\t\tx", "-\t\t\t\t\t", "METABOLITES_END",
    "EXTENDED_MS_METABOLITE_DATA_START", "metabolite_name\tsample_id\tx", "m1\ts1\t1", "\ts9\t1", "m1\tNA\t1", "EXTENDED_MS_METABOLITE_DATA_END", "#END",
]
_JSON = '{"MS": {"MS_TYPE": "ESI"}, "MS_METABOLITE_DATA": {"Units": "count", "Data": [{"Metabolite": "m1", "s1": "1"}, {"Metabolite": "m1", "s1": "1"}, {"s2": "2"}], "Metabolites": [{"Metabolite": null, "ri": ""}]}}'


def _read(spark, texts):
    return to_tables(spark.createDataFrame([(k, v, None) for k, v in texts.items()], "file_id string, text string, error string"))


def _found(t, **more):
    return sorted((r.file_id, r.id, r.section, r.sub_section, r.message) for r in issues(t, **more).collect())


def test_as_cell_by_cell(spark):
    t = _read(spark, _TEXTS | {"tables": "\n".join([*_HEAD, *_TABLES]), "json": _JSON}).kept("files", "items", "ssf", "headers", "factors", "blocks", "results")
    assert t.grids is not None and replace(t).grids is None
    got = _found(t, store=True)
    assert got == _found(replace(t), store=True)
    assert {n for f, n, *_ in got if f == "tables"} >= {8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 22, 23, 27, 28, 29, 31, 35, 36}
    assert {n for f, n, *_ in got if f == "json"} >= {11, 13, 25, 29}


def test_regular_text_is_not_read_cell_by_cell(spark):
    t = _read(spark, {"tables": "\n".join([*_HEAD, *_TABLES]), "twice": _TEXTS["twice"]})
    assert {(r.file_id, r.tbl) for r in shared(t).loose.collect()} == {("twice", "Data")}
    assert {(r.file_id, r.tbl) for r in t.grids.collect()} == {("tables", "Data"), ("tables", "Metabolites"), ("tables", "Extended"), ("twice", "Extended")}
