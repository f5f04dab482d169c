"""Rows of JSON tables that lack columns are filled within the row."""

from assayspark.operators.read import to_tables
from assayspark.operators.render import filled

_JSON = '{"MS": {"MS_TYPE": "ESI"}, "MS_METABOLITE_DATA": {"Units": "count", "Data": [{"Metabolite": "m1", "s1": "1"}, {"s3": "3", "Metabolite": "m2", "s2": null}, {}, {"Metabolite": "m3", "s2": "2", "s1": "0", "s3": ""}]}}'


def test_lacking_cells(spark):
    rows = filled(to_tables(spark.createDataFrame([("a", _JSON, None)], "file_id string, text string, error string")))
    assert {r["row"]: r["values"] for r in rows.collect()} == {0: ["m1", "1", "", ""], 1: ["m2", "", "3", ""], 3: ["m3", "0", "", "2"]}
