"""Headers read and set."""

import json

import pytest

from assayspark.operators.headers import headers_of, with_headers
from assayspark.operators.read import to_tables
from assayspark.operators.render import to_text
from assayspark.sources.files import from_texts

BODY = "VERSION\t1\nCREATED_ON\t2020\n#MS\nMS:MS_TYPE\tESI\n#END\n"


def test_headers(spark):
    docs = {"a": "#METABOLOMICS WORKBENCH STUDY_ID:ST000001 ANALYSIS_ID:AN000001\n" + BODY, "b": "#METABOLOMICS WORKBENCH STUDY_ID:ST000002\n" + BODY, "c": json.dumps({"MS": {"MS_TYPE": "ESI"}})}
    t = to_tables(from_texts(spark, docs)).kept()
    new = [("a", "#METABOLOMICS WORKBENCH name.txt PROJECT_ID:PR000009 STUDY_ID:ST000003 STUDY_ID:ST000004"), ("c", "#METABOLOMICS WORKBENCH STUDY_ID:ST000005"), ("gone", "#METABOLOMICS WORKBENCH A:b")]
    changed = with_headers(t, spark.createDataFrame(new, "file_id string, header string"))
    want = {"a": "#METABOLOMICS WORKBENCH STUDY_ID:ST000004 ANALYSIS_ID:AN000001 PROJECT_ID:PR000009", "b": "#METABOLOMICS WORKBENCH STUDY_ID:ST000002", "c": "#METABOLOMICS WORKBENCH STUDY_ID:ST000005"}
    assert {r.file_id: r.header for r in headers_of(changed).collect()} == want
    assert {r.file_id: r.text.split("\n")[0] for r in to_text(changed).collect()} == want
    assert changed.items.filter("section <> 'METABOLOMICS WORKBENCH'").count() == t.items.filter("section <> 'METABOLOMICS WORKBENCH'").count()
    assert sorted(r.key for r in changed.items.filter("file_id = 'a' AND section = 'METABOLOMICS WORKBENCH'").collect()) == ["ANALYSIS_ID", "CREATED_ON", "PROJECT_ID", "STUDY_ID", "VERSION"]
    with pytest.raises(Exception, match="A header begins with"):
        with_headers(t, spark.createDataFrame([("a", "zxcv")], "file_id string, header string")).items.collect()
