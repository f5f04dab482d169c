"""Text documents are read within their rows: odd ones as document by document, and without a shuffle of their cells."""

from assayspark.functions.one_document import SCHEMAS, rows_of
from assayspark.operators.parse_text import text_tables

_HEAD = ["#METABOLOMICS WORKBENCH STUDY_ID:ST000001 ANALYSIS_ID:AN000001", "VERSION\t1", "#SUBJECT_SAMPLE_FACTORS:\tSUBJECT\tSAMPLE\tFACTORS\tMORE", "SUBJECT_SAMPLE_FACTORS\t-\ts1\tA:b\t", "#MS", "MS:MS_TYPE\tESI", "#MS_METABOLITE_DATA"]
_ODD = [*_HEAD, "MS_METABOLITE_DATA_START", 'Samples\ts1\t"s1"\ts2 \ts1', "Factors\tA:b\tA:b\tA:b\tA:b", "#not a section\t1\t\t3\t\t \t", "m2\t1\t2\t3\t4\t5\t6", "", "m3", "MS_METABOLITE_DATA_END", "#METABOLITES", "METABOLITES_START", "metabolite_name\tx", "m2\t1", "METABOLITES_END", "#END"]
_TWICE = [*_HEAD, "MS_METABOLITE_DATA_START", "Samples\ts1", "m1\t1", "MS_METABOLITE_DATA_END", "MS_METABOLITE_DATA_START", "m4\t4", "m5\t5", "EXTENDED_MS_METABOLITE_DATA_START", "metabolite_name\tsample_id", "m1\ts1", "EXTENDED_MS_METABOLITE_DATA_END", "_START", "MS:LATE\tx", "#END"]
_TEXTS = {"odd": "\r\n".join(_ODD), "twice": "\n".join(_TWICE), "empty": "\n\n" + _HEAD[0] + "\nMS_METABOLITE_DATA_START"}


def test_as_document_by_document(spark):
    t = text_tables(spark.createDataFrame([(k, v, None) for k, v in _TEXTS.items()], "file_id string, text string, error string"))
    for table in SCHEMAS:
        df = getattr(t, table)
        names = ["file_id"] + [f.split()[0] for f in SCHEMAS[table].split(", ")] if table != "ssf" else ["file_id", "idx", "subject_id", "sample_id"]
        got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
        assert got == sorted(repr((k, *row)[: len(names)]) for k, v in _TEXTS.items() for row in rows_of(v, table)), table
    assert {(r.file_id, r.tbl, r.pos, r.column, r.dup, r.named) for r in t.headers.collect() if r.file_id == "odd" and r.tbl == "Data"} == {
        ("odd", "Data", p, c, d, n) for p, (c, d, n) in enumerate([("Metabolite", 0, True), ("s1", 0, True), ("s1", 1, True), ("s2", 0, True), ("s1", 2, True), ("", 0, False), ("", 1, False)])
    }


def test_cells_are_not_shuffled(spark):
    t = text_tables(spark.createDataFrame([(k, v, None) for k, v in _TEXTS.items()], "file_id string, text string, error string"))
    assert "Exchange" not in t.cells._jdf.queryExecution().executedPlan().toString()
