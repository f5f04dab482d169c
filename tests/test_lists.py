"""Tables of JSON documents, each listed within one row: cells, headers and text follow from it without a shuffle."""

import json
from dataclasses import replace

from assayspark.functions.one_document import rows_of
from assayspark.operators.parse_text import text_cells, text_tables
from assayspark.operators.read import to_tables
from assayspark.operators.render import to_text
from tests.test_filled import _JSON
from tests.test_located import _TEXTS


def _json(*sections):
    return "{" + ", ".join(f'"{name}": {{"Units": "x", ' + ", ".join(f'"{tbl}": {rows}' for tbl, rows in tables) + "}" for name, tables in sections) + "}"


DOCUMENTS = {
    "plain": _JSON,
    "raw": _json(("MS_METABOLITE_DATA", [("Data", '[{"s1": 1, "Metabolite": "m", "s2": null, "s3": {"a": [1, "x"]}}, {"Metabolite": "n", "s3": true}]')])),
    "repeated": _json(("MS_METABOLITE_DATA", [("Data", '[{"Metabolite": "m", "s2": "1", "s1": "2", "s2": "3"}, {"s1": "", "Metabolite": "n", "Metabolite": "o", "s3": "é\\t"}]')])),
    "binned": _json(("NMR_BINNED_DATA", [("Data", '[{"s1": "1", "Bin range(ppm)": "0.1"}, {"Bin range(ppm)": "0.2", "s2": "5"}]')])),
    "empty rows": _json(("MS_METABOLITE_DATA", [("Data", "[{}, {}]"), ("Metabolites", '[{}, {"Metabolite": "m", "id": "1"}]'), ("Extended", "[]")])),
    "two sections": _json(
        ("MS_METABOLITE_DATA", [("Data", '[{"Metabolite": "m", "s2": "1"}, {"s1": "2", "Metabolite": "n"}]'), ("Metabolites", '[{"Metabolite": "m"}]')]),
        ("NMR_METABOLITE_DATA", [("Data", '[{"s3": "7", "Metabolite": "o"}, {}, {"s1": "9"}]')]),
    ),
    "given twice": _json(("MS_METABOLITE_DATA", [("Data", '[{"Metabolite": "m", "s2": "1"}]'), ("Data", '[{"s1": "2"}]')])),
    "bad": '{"MS_METABOLITE_DATA": {"Data": [1]}}',
}


def _tables(spark):
    return to_tables(spark.createDataFrame([(k, v, None) for k, v in (DOCUMENTS | _TEXTS).items()], "file_id string, text string, error string"))


def test_cells_and_headers(spark):
    """Each column has one place: the metabolite first, then as they first turn up, by row and place in the row."""
    t = _tables(spark)
    assert not any(word in t.cells._jdf.queryExecution().executedPlan().toString() for word in ("Exchange", "Window", "Join"))
    got = [r for r in t.cells.collect() if r.file_id in DOCUMENTS]
    assert {r.file_id for r in got} == set(DOCUMENTS) - {"bad"}
    headers = {}
    for r in t.headers.filter("named").collect():
        headers.setdefault((r.file_id, r.tbl), []).append((r.pos, r.column, r["dup"]))
    for (file_id, tbl) in {(r.file_id, r.tbl) for r in got}:
        own = [r for r in got if (r.file_id, r.tbl) == (file_id, tbl)]
        first = {}
        for r in own:
            first[r.column, r["dup"]] = min(first.get((r.column, r["dup"]), (9, 9)), (r["row"], r["at"]))
        assert [(c, d) for _, c, d in sorted(headers[file_id, tbl])][0] == ("Metabolite", 0)
        rest = [first[c, d] for _, c, d in sorted(headers[file_id, tbl])[1:]]
        assert rest == sorted(rest) and {(r.pos, r.column, r["dup"]) for r in own} == set(headers[file_id, tbl])
    as_rows = lambda rows: sorted(map(repr, rows))
    one = [(k, *x) for k, v in DOCUMENTS.items() if k != "bad" for x in rows_of(v, "cells")]
    assert as_rows(tuple(r) for r in got) == as_rows(one)
    want = {(i, k, v if isinstance(v, str) or v is None else json.dumps(v)) for i, row in enumerate(json.loads(DOCUMENTS["raw"])["MS_METABOLITE_DATA"]["Data"]) for k, v in row.items()}
    assert {(r["row"], r.column, r.value) for r in got if r.file_id == "raw"} == want


def test_text_of_whole_tables(spark):
    """Lists and grids are written as their cells would be; what is read again has each value in its column."""
    t = _tables(spark)
    kept = t.kept("files", "items", "ssf", "headers", "factors", "blocks", "results")
    assert t.lists is not None and replace(t).lists is None and kept.lists is not None and t.kept().lists is None
    got, want = ({r.file_id: r.text for r in to_text(x).collect()} for x in (kept, replace(t)))
    assert got == want and len(got) > 8
    texts = spark.createDataFrame([(k, v, None) for k, v in got.items()], "file_id string, text string, error string")
    assert sorted(map(repr, text_cells(texts).collect())) == sorted(map(repr, text_tables(texts).cells.collect()))
