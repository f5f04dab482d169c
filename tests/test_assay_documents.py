"""Documents read, checked, extracted and written; the documents are small ones of our own, parsed once for all tests."""

from __future__ import annotations

import bz2
import gzip
import json
import os
import re
import tarfile
import zipfile
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayspark import cli
from assayspark.operators.extract import matchers, measurements, metabolite_counts, metabolite_samples, metadata, parse_condition
from assayspark.functions.finders import Finder
from assayspark.model import run, shared_folder
from assayspark.operators import rules, schema_tree
from assayspark.operators.read import read_with, to_tables
from assayspark.operators.render import to_json, to_text
from assayspark.operators.schema import from_json_schema, known_keys, schema_issues
from assayspark.operators.schema_tree import broken, tree_issues
from assayspark.operators.validate import CATALOGUE, issues, summary
from assayspark.plans import document_queries
from assayspark.sources import rest
from assayspark.operators.wide import table_of, with_table
from assayspark.sources.files import from_dicts, from_texts, read_documents, read_ids
from assayspark.sources.sinks import write_documents

HEAD = ["#METABOLOMICS WORKBENCH STUDY_ID:ST000001 ANALYSIS_ID:AN000001 PROJECT_ID:PR000001", "VERSION             \t1", "CREATED_ON          \t2020-01-01"]


def text(samples=("s1", "s2"), ssf=("s1", "s2"), rows=("m1\t1\t2", "m2\t0\t3"), names=("m1", "m2"), items=(), column="pubchem_id", values=("1", "2")) -> str:
    out = [*HEAD, "#PROJECT", "PR:PROJECT_TITLE                 \ttitle", *items, "#SUBJECT", "SU:SUBJECT_TYPE                  \tHuman"]
    out += ["#SUBJECT_SAMPLE_FACTORS:         \tSUBJECT(optional)[tab]SAMPLE[tab]FACTORS(NAME:VALUE pairs separated by |)[tab]Additional sample data"]
    out += [f"SUBJECT_SAMPLE_FACTORS           \t-\t{s}\tTissue:liver | Age:{i}\tRAW=f{i}.raw; RUN={i}" for i, s in enumerate(ssf)]
    out += ["#MS", "MS:MS_TYPE                       \tESI", "#MS_METABOLITE_DATA", "MS_METABOLITE_DATA:UNITS         \tcount", "MS_METABOLITE_DATA_START"]
    out += ["\t".join(("Samples", *samples)), "\t".join(("Factors", *(f"Tissue:liver | Age:{ssf.index(s)}" if s in ssf else "Tissue:liver" for s in samples))), *rows, "MS_METABOLITE_DATA_END"]
    out += ["#METABOLITES", "METABOLITES_START", f"metabolite_name\t{column}", *(f"{n}\t{v}" for n, v in zip(names, values, strict=False)), "METABOLITES_END", "#END"]
    return "\n".join(out) + "\n"


WORDS = " ".join(("a summary of many words " * 12).split())
AS_JSON = {
    "METABOLOMICS WORKBENCH": {"STUDY_ID": "ST000003", "ANALYSIS_ID": "AN000003", "VERSION": "1", "CREATED_ON": "2020-01-01"},
    "PROJECT": {"PROJECT_TITLE": 'a "title"\\ é'},
    "SUBJECT_SAMPLE_FACTORS": [{"Subject ID": "-", "Sample ID": "s1", "Factors": {"Tissue": "liver"}}],
    "MS": {"MS_TYPE": "ESI"},
    "MS_METABOLITE_DATA": {"Units": "count", "Data": [{"Metabolite": "m1", "s1": "1"}, {"Metabolite": "m2", "s1": ""}]},
}
DOCUMENTS = {
    "plain": text(),
    "wrapped": text(items=("PR:PROJECT_SUMMARY               \t" + WORDS,)).replace("\n", "\r\n"),
    "json": json.dumps(AS_JSON),
    "mouse": text().replace("ST000001", "ST000002").replace("AN000001", "AN000002").replace("Human", "Mouse"),
    "blank": " \n",
    "junk": "what",
    "same key": json.dumps({"A": {}})[:-1] + ', "A": {}}',
    "odd rows": json.dumps({"MS_METABOLITE_DATA": {"Data": ["x", {"Metabolite": "m"}]}}),
    "no tab": text(items=("PR:DOI",)),
    "bad pair": text().replace("Tissue:liver | Age:0\tRAW", "Tissue:liver Age:0\tRAW"),
    "7": text(ssf=("s1",)),
    "4": text(ssf=("s1", "s1", "s2")),
    "9 12": text(names=("m1", "m3")),
    "8": text(samples=("s1", "s1")),
    "2 11 26 29": text(rows=("m1\t1\t2", "m1\t1\t2", "m2\t0\t3\t4")),
    "15 16": text(column="KEGG", values=("C00001", "nothing like it")),
    "23": text(names=("m1", "samples"), rows=("m1\t1\t2", "samples\t0\t3")),
    "3": text().replace("Tissue:liver | Age:0\tT", "Tissue:heart | Age:0\tT"),
    "1": text(items=("PR:PROJECT_TITLE                 \ttitle",)),
    "32": text().replace("#MS\nMS:MS_TYPE                       \tESI\n", ""),
    "31": text(column="polarity", values=("positive", "negative")),
    "27": text(values=("", "NA")),
    "rules": text(items=("PR:EMAIL                         \tat home", "PR:PHONE                         \tN/A", "PR:DOI                           \tnone")),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, v, None) for k, v in DOCUMENTS.items()]
    return to_tables(spark.createDataFrame(rows, "file_id string, text string, error string")).kept()


def only(t, *names):
    return replace(t, files=t.files.filter(F.col("file_id").isin(*names)))


def test_parts(parsed):
    sample = parsed.ssf.filter("file_id = 'plain' AND idx = 1").first()
    assert (sample.subject_id, sample.sample_id) == ("-", "s2")
    assert [(p.key, p.value, p.dup) for p in sample.factors] == [("Tissue", "liver", 0), ("Age", "1", 0)]
    assert [(p.key, p.value) for p in sample.additional] == [("RAW", "f1.raw"), ("RUN", "1")]
    assert {tuple(r) for r in parsed.files.filter("file_id IN ('plain', 'json')").collect()} == {("plain", "text", "MS_METABOLITE_DATA", None), ("json", "json", "MS_METABOLITE_DATA", None)}


def test_what_cannot_be_read(parsed):
    errors = {r.file_id: r.error for r in parsed.files.collect()}
    assert set(errors) == set(DOCUMENTS)
    assert errors["blank"].startswith("Blank") and errors["junk"].startswith("Unknown") and "KeyError" in errors["same key"] and "TypeError" in errors["odd rows"]
    assert errors["no tab"].endswith("in: PR:DOI") and "liver Age" in errors["bad pair"] and errors["plain"] is None


def test_written_as_text(parsed):
    written = {r.file_id: r.text for r in to_text(only(parsed, "plain", "wrapped")).collect()}
    assert written["plain"] == text()
    lines = [x.split("\t")[1] for x in written["wrapped"].split("\n") if x.startswith("PR:PROJECT_SUMMARY")]
    assert len(lines) > 1 and all(len(x) <= 80 for x in lines) and " ".join(lines) == WORDS


def test_written_as_json(parsed):
    written = {r.file_id: r.text for r in to_json(only(parsed, "plain", "json")).collect()}
    assert json.loads(written["json"]) == AS_JSON
    held = json.loads(written["plain"])
    assert written["plain"] == json.dumps(held, indent=4)
    assert list(held) == ["METABOLOMICS WORKBENCH", "PROJECT", "SUBJECT", "SUBJECT_SAMPLE_FACTORS", "MS", "MS_METABOLITE_DATA"]
    assert held["SUBJECT_SAMPLE_FACTORS"][0] == {"Subject ID": "-", "Sample ID": "s1", "Factors": {"Tissue": "liver", "Age": "0"}, "Additional sample data": {"RAW": "f0.raw", "RUN": "0"}}
    assert held["MS_METABOLITE_DATA"]["Data"] == [{"Metabolite": "m1", "s1": "1", "s2": "2"}, {"Metabolite": "m2", "s1": "0", "s2": "3"}]


def test_checks(spark, parsed, tmp_path):
    issues(parsed).write.parquet(str(tmp_path / "issues"))
    found = spark.read.parquet(str(tmp_path / "issues"))
    ids: dict[str, list[int]] = {}
    for row in found.collect():
        ids.setdefault(row.file_id, []).append(row.id)
    assert "plain" not in ids and "mouse" not in ids
    got = {name: set(ids.get(name, ())) for name in DOCUMENTS if name[0].isdigit()}
    # where a sample is left out or given twice, the factors that the data repeat differ too
    assert got == {name: set(map(int, name.split())) | ({3} if name in ("7", "4") else set()) for name in got}
    assert ids["23"].count(23) == 2
    rows = {r.file_id: r for r in summary(only(parsed, "plain", "4", "junk").files, found.filter("id = 4")).collect()}
    assert set(rows) == {"plain", "4"}
    assert rows["plain"].status == "Passing" and (rows["4"].n_issues, rows["4"].n_warnings) == (1, 1)
    assert [tuple(x) for x in rows["4"].tags] == [("value", 1)]


def test_schema_rules(parsed):
    t = only(parsed, "rules")
    found = {(r.name.split(": ")[1], r.section, r.sub_section) for r in schema_issues(t).filter("file_id = 'rules'").collect()}
    assert {("format", "PROJECT", "EMAIL"), ("not", "PROJECT", "PHONE"), ("pattern", "PROJECT", "DOI"), ("required", "PROJECT", "INSTITUTE"), ("required", "STUDY", "")} <= found
    assert not any(key == "PROJECT_TITLE" for _, _, key in found)
    keys = {"NAME": {}, "PHONE": {"not": {"enum": ["N/A"]}}, "EMAIL": {"minLength": 20}, "DOI": {"enum": ["x"]}}
    own = {"required": ["PROJECT", "OTHER"], "properties": {"PROJECT": {"required": ["NAME"], "additionalProperties": False, "properties": keys}}}
    found = {(r.name.split(": ")[1], r.section, r.sub_section) for r in schema_issues(t, from_json_schema(own)).collect()}
    assert found == {
        ("required", "OTHER", ""), ("required", "PROJECT", "NAME"), ("additionalProperties", "PROJECT", "PROJECT_TITLE"),
        ("not", "PROJECT", "PHONE"), ("minLength", "PROJECT", "EMAIL"), ("enum", "PROJECT", "DOI"),
    }


def test_unknown_keys_and_sections(spark):
    """Every user's misspelt key is an issue; a section of the other method is not known."""
    docs = {"key": text(items=("PR:PROJECT_TITEL                 \ttitle",)), "section": text().replace("#MS\n", "#BADSECTION\nXX:KEY\tvalue\n#MS\n"), "right": text(items=("PR:PUBLICATIONS                  \tnone yet",)), "nmr": text().replace("#MS\nMS:MS_TYPE", "#NM\nNM:INSTRUMENT_NAME")}
    t = to_tables(from_texts(spark, docs)).kept()
    found = {(r.file_id, r.section, r.sub_section) for r in schema_issues(t).filter("name = 'JSON Schema Error: additionalProperties'").collect()}
    assert found == {("key", "PROJECT", "PROJECT_TITEL"), ("section", "BADSECTION", ""), ("nmr", "MS_METABOLITE_DATA", "")}
    known = known_keys()
    assert {"PROJECT_TITLE", "EMAIL", "DOI"} <= set(known["PROJECT"]) and "COLLECTION_PROTOCOL_ID" in known["COLLECTION"] and len(known["MS"]) == 51


TREE = {
    "type": "object", "additionalProperties": False, "required": ["NEEDED"], "properties": {
        "FOR_TEST": {
            "type": "object", "additionalProperties": False, "required": ["GONE"], "properties": {
                "MIN_PROPERTIES": {"type": "object", "minProperties": 1}, "TEXT": {"type": "string", "minLength": 3, "maxLength": 5}, "LONG": {"maxLength": 2}, "MIN_ITEMS": {"type": "array", "minItems": 1},
                "MIN_ITEMS2": {"type": "array", "minItems": 2}, "TYPES": {"type": ["string", "null"]}, "ENUM": {"enum": ["a", "b"]}, "PATTERN": {"pattern": "^a$"}, "MIN": {"type": "integer", "minimum": 15},
                "MAX": {"type": "integer", "maximum": 5}, "UNIQUE": {"type": "array", "uniqueItems": True}, "NOT": {"not": {"oneOf": [{"enum": ["q"]}, {"pattern": "asdf", "pattern_custom_message": " holds asdf."}]}},
                "ANY": {"anyOf": [{"enum": ["x"]}, {"minLength": 10}]}, "ALL": {"allOf": [{"minLength": 1}, {"maxLength": 2}]}, "ONE": {"oneOf": [{"minLength": 1}, {"maxLength": 2}]}, "MAIL": {"format": "email"},
                "NEST": {"type": "array", "items": {"properties": {"k": {"type": "number"}}, "additionalProperties": {"minLength": 1, "minLength_prefix": "Warning: "}}}, "a/b": {"minLength": 2},
            },
        },
        "SUBJECT_SAMPLE_FACTORS": {"type": "array", "items": {"properties": {"Sample ID": {"not": {"enum": ["", "NA"]}}, "Factors": {"additionalProperties": {"minLength": 1}}}, "required": ["Subject ID"]}},
    },
}


def test_schema_trees(spark):
    """Every keyword, at every depth, and which branch of a combination decided."""
    bad = {
        "MIN_PROPERTIES": {}, "TEXT": "ab", "LONG": "abc", "MIN_ITEMS": [], "MIN_ITEMS2": ["a"], "TYPES": 1, "ENUM": "z", "PATTERN": "z", "MIN": 10, "MAX": 10, "UNIQUE": ["a", {"b": 1}, {"b": 1}], "NOT": "asdf", "ANY": "y",
        "ALL": "abc", "ONE": "a", "NEST": [{"k": 1.5, "o": ""}, {"k": "x", "p": "y"}], "MAIL": "x", "ODD": 1, "a/b": "c",
    }
    good = {
        "GONE": None, "MIN_PROPERTIES": {"a": 1}, "TEXT": "abcd", "LONG": "", "MIN_ITEMS": [1], "MIN_ITEMS2": ["a", "a"], "TYPES": None, "ENUM": "b", "PATTERN": "a", "MIN": 15, "MAX": -1, "UNIQUE": [1, "1", 2], "NOT": "q asd",
        "ANY": "x", "ALL": "ab", "ONE": "abc", "NEST": [{"k": 1}, {"o": "y"}], "MAIL": "x@y", "a/b": "cc",
    }
    good.pop("GONE")
    docs = {
        "bad": {"FOR_TEST": bad, "SUBJECT_SAMPLE_FACTORS": [{"Subject ID": "-", "Sample ID": "NA", "Factors": {"T": "", "U": "v"}}], "BAD": {"A": "b"}},
        "good": {"NEEDED": {"A": "b"}, "FOR_TEST": {"GONE": "is here", **good}, "SUBJECT_SAMPLE_FACTORS": [{"Subject ID": "-", "Sample ID": "s", "Factors": {"T": "v"}}]},
    }
    schema = json.loads(json.dumps(TREE))
    schema["properties"] |= {"NEEDED": {}}
    schema["properties"]["FOR_TEST"]["properties"] |= {"GONE": {}}
    t = to_tables(from_dicts(spark, docs)).kept()
    got = {(r.file_id, r.path.replace("/FOR_TEST", ".."), r.keyword, r.branch) for r in broken(t, schema).collect()}
    single = {"MIN_PROPERTIES": "minProperties", "TEXT": "minLength", "LONG": "maxLength", "MIN_ITEMS": "minItems", "MIN_ITEMS2": "minItems", "TYPES": "type", "ENUM": "enum", "PATTERN": "pattern", "MIN": "minimum", "MAX": "maximum", "UNIQUE": "uniqueItems", "MAIL": "format", "a//b": "minLength", "ODD": "additionalProperties"}
    want = {("bad", f"../{k}", word, None) for k, word in single.items()} | {("bad", "../ANY", "anyOf", None), ("bad", "../ALL", "allOf", "minLength"), ("bad", "../ONE", "oneOf", "minLength"), ("bad", "../NOT", "not", "pattern")}
    want |= {("bad", "", "required", None), ("bad", "..", "required", None), ("bad", "/BAD", "additionalProperties", None), ("bad", "../NEST/0/o", "minLength", None), ("bad", "../NEST/1/k", "type", None)}
    want |= {("bad", "/SUBJECT_SAMPLE_FACTORS/0/Factors/T", "minLength", None), ("bad", "/SUBJECT_SAMPLE_FACTORS/0/Sample ID", "not", "enum")}
    assert {g for g in got if g[:2] != ("good", "") and g[0] == "bad"} == want
    assert not {g for g in got if g[0] == "good"}
    found = {(r.sub_section, r.name.split(": ")[1], r.severity, r.message) for r in tree_issues(t, schema).collect()}
    assert ("NOT", "pattern", "Error", 'Error: The value, "asdf", at /FOR_TEST/NOT holds asdf.') in found
    assert ("a/b", "minLength", "Error", 'Error: The value, "c", at /FOR_TEST/a//b is shorter than 2.') in found
    assert any(f[:3] == ("NEST", "minLength", "Warning") for f in found) and len(found) == len(want)
    assert broken(t.union(to_tables(from_texts(spark, {"junk": "what"}))), schema).filter("file_id = 'junk'").collect() == []


def test_extract(parsed):
    t = only(parsed, "plain", "mouse")
    assert {r[0]: tuple(r)[1:] for r in metabolite_counts(measurements(t)).collect()} == {"m1": (2, 2, 4), "m2": (2, 2, 2)}
    found = measurements(t, matchers([parse_condition("SU:SUBJECT_TYPE=Mouse")]))
    assert {tuple(r)[:3] + (tuple(r.samples),) for r in metabolite_samples(found).collect()} == {("m1", "ST000002", "AN000002", ("s1", "s2")), ("m2", "ST000002", "AN000002", ("s2",))}
    assert measurements(t, matchers([("SU:SUBJECT_TYPE", re.compile("^H"))])).select("study_id").distinct().collect()[0][0] == "ST000001"
    assert measurements(t, matchers([("SU:SUBJECT_TYPE", lambda v: F.lower(v) == "mouse")])).select("study_id").distinct().collect()[0][0] == "ST000002"
    assert [tuple(r) for r in metadata(t, ["SUBJECT_TYPE"]).collect()] == [("SUBJECT_TYPE", ["Human", "Mouse"])]


def test_files_and_archives(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    (source / "a.txt").write_text("one")
    (source / "deep/b.TXT").write_text("two")
    (source / "c.dat").write_text("left out")
    docs = read_documents(spark, str(source), str(tmp_path / "nothing"))
    good = docs.filter("error IS NULL")
    assert {(r.file_id.rsplit("/", 1)[1], r.text) for r in good.collect()} == {("a.txt", "one"), ("b.TXT", "two")}
    assert docs.filter("error IS NOT NULL").first().error == "Unknown file source."
    for kind in ("", "gz", "bz2", "zip", "tar", "tar.gz", "tar.bz2"):
        out = tmp_path / f"out-{kind}"
        write_documents(good.repartition(1), str(out), "txt", kind)
        files = sorted(p for p in out.rglob("*") if p.is_file() and not p.name.startswith("."))
        if kind == "zip":
            with zipfile.ZipFile(files[0]) as held:
                texts = [held.read(n).decode() for n in held.namelist()]
        elif kind.startswith("tar"):
            with tarfile.open(files[0]) as held:
                texts = [held.extractfile(m).read().decode() for m in held]
        else:
            texts = [{"": bytes, "gz": gzip.decompress, "bz2": bz2.decompress}[kind](p.read_bytes()).decode() for p in files]
        assert sorted(texts) == ["one", "two"], kind
        assert {r.text for r in read_documents(spark, *map(str, files)).collect()} == {"one", "two"}, kind


def test_names_below_the_common_folder(spark, tmp_path):
    """Documents of one name in several folders are files of their own; names that clash raise an error."""
    rows = [("file:/x/in/a/d.txt", "one"), ("file:/x/in/b/d.txt", "two"), ("file:/x/in/c.zip/b/../d.json", "three")]
    write_documents(spark.createDataFrame(rows, "file_id string, text string"), str(tmp_path / "out"), "json")
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.json")}
    assert got == {"a/d.txt.json": "one", "b/d.txt.json": "two", "c.zip/b/d.json": "three"}
    with pytest.raises(ValueError, match="d.txt"):
        write_documents(spark.createDataFrame([("/a/d", "x"), ("/a/d.txt", "y")], "file_id string, text string"), str(tmp_path / "none"), "txt")
    assert not (tmp_path / "none").exists()


def test_many_paths_are_two_scans(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i % 4}[x]").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 4}[x]" / f"f{i}.{'dat' if i % 5 == 0 else 'Txt'}").write_text(str(i))
    paths = [str(p) for p in tmp_path.rglob("*") if p.is_file() and "d0" not in str(p)]
    docs = read_documents(spark, *[p.replace("[", "\\[").replace("]", "\\]") for p in paths], str(tmp_path / "d0*"), str(tmp_path / "none*"))
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    got = docs.collect()
    assert sorted(int(r.text) for r in got if r.error is None) == [i for i in range(40) if i % 4 or i % 5]
    assert [r.error for r in got if r.error] == ["Unknown file source."]


def test_other_sources_and_readers(spark, tmp_path):
    typed = AS_JSON | {"MS": {"MS_TYPE": 5, "ION_MODE": None, "OTHER": {"a": [1, True]}}, "MS_METABOLITE_DATA": {"Units": "count", "Data": [{"s1": 1.5, "Metabolite": "m1", "s2": "1"}]}}
    t = to_tables(from_dicts(spark, {"mine": AS_JSON, "typed": typed}))
    got = {r.file_id: r.text for r in to_json(t).collect()}
    assert json.loads(got["mine"]) == AS_JSON and json.loads(got["typed"]) == typed
    assert list(json.loads(got["typed"])["MS_METABOLITE_DATA"]["Data"][0]) == ["Metabolite", "s1", "s2"]
    (tmp_path / "ids.json").write_text('["AN000001", "ST000002", null, "7"]')
    assert [r.id for r in read_ids(spark, str(tmp_path / "ids.json")).collect()] == ["AN000001", "ST000002", "7"]
    docs = from_texts(spark, {"a": "1,2\n3,4", "b": "what"}).unionByName(spark.createDataFrame([("c", None, "gone")], "file_id string, text string, error string"))
    got = read_with(docs, lambda text: [tuple(map(int, x.split(","))) for x in text.split("\n")], "x int, y int").collect()
    assert sorted((r.file_id, r.x, r.y) for r in got if r.error is None) == [("a", 1, 2), ("a", 3, 4)]
    assert {r.file_id: r.error.split(":")[0] for r in got if r.error} == {"b": "ValueError", "c": "gone"}
    with pytest.raises(Exception, match="Unknown file format"):
        to_tables(from_texts(spark, {"b": "what"}), on_error="raise").files.collect()


def test_wide_tables_both_ways(parsed):
    wide = table_of(parsed, "8", "Data")
    assert wide.columns == ["row", "Metabolite", "s1", "s1{{{_1_}}}"]
    assert [tuple(r) for r in wide.collect()] == [(0, "m1", "1", "2"), (1, "m2", "0", "3")]
    assert table_of(parsed, "plain", "Extended").columns == ["row"]
    new = with_table(parsed, "8", "Data", wide.withColumn("new `x`", F.lit(None)).drop("s1{{{_1_}}}").orderBy(F.desc("row")), "row")
    assert [tuple(r) for r in table_of(new, "8", "Data").collect()] == [(0, "m1", "1", ""), (1, "m2", "0", "")]
    assert table_of(new, "plain", "Data").count() == 2 and table_of(new, "8", "Data").columns[-1] == "new `x`"


RAGGED = [{"Metabolite": "m1", "s1": "1", "s2": "2"}, {"Metabolite": "m2", "s2": "5"}, {"s2": "7", "s3": "9", "Metabolite": "m3", "s1": "8"}, {"Metabolite": "m4"}]


def _ragged(spark, rows, table="Data"):
    body = {"MS": {"MS_TYPE": "ESI"}, "MS_METABOLITE_DATA": {"Units": "count", "Data": [{"Metabolite": r["Metabolite"], "s1": "1"} for r in rows], table: rows}}
    return to_tables(from_dicts(spark, {"a": body, "b": {"MS": {}, "MS_METABOLITE_DATA": {"Units": "x", "Data": rows[:1]}}}))


def test_ragged_rows_keep_their_values(spark):
    """JSON to text to JSON: every value stays in its column; what a row lacks becomes empty. JSON to JSON changes nothing."""
    t = _ragged(spark, RAGGED).kept()
    assert json.loads({r.file_id: r.text for r in to_json(t).collect()}["a"])["MS_METABOLITE_DATA"]["Data"] == RAGGED
    texts = {r.file_id: r.text for r in to_text(t).collect()}
    assert "m2\t\t5\t\nm3\t8\t7\t9\nm4\t\t\t\n" in texts["a"]
    again = to_tables(from_texts(spark, texts)).kept()
    back = {r.file_id: json.loads(r.text)["MS_METABOLITE_DATA"]["Data"] for r in to_json(again).collect()}
    assert back["a"] == [{c: row.get(c, "") for c in ("Metabolite", "s1", "s2", "s3")} for row in RAGGED] and back["b"] == RAGGED[:1]
    assert {r.file_id for r in issues(t, numbers=(25,)).collect()} == {"a"}


def test_checks_of_ragged_rows_read_the_right_cells(spark):
    """Checks 16, 18 and 31 join columns to cells by place, which rows in another order don't change."""
    rows = [{"Metabolite": "m1", "kegg_id": "C00001", "polarity": "positive", "other_id": "x", "other_id_type": "db"}, {"Metabolite": "m2", "polarity": "negative", "kegg_id": "C00002"}, {"other_id_type": "db", "Metabolite": "m3", "other_id": "y"}]
    found = {(r.file_id, r.id) for r in issues(_ragged(spark, rows, "Metabolites").kept(), numbers=(16, 18, 31)).collect()}
    assert found == {("a", 31)}
    rows[2].pop("other_id")
    rows[1]["kegg_id"] = "nothing like it"
    found = {(r.file_id, r.id) for r in issues(_ragged(spark, rows, "Metabolites").kept(), numbers=(16, 18, 31)).collect()}
    assert found == {("a", 16), ("a", 18), ("a", 31)}


def test_a_new_table_is_written_and_read_again(spark):
    t = to_tables(from_texts(spark, {"a": text().split("#METABOLITES")[0] + "#END\n", "b": text()})).kept()
    wide = spark.createDataFrame([(1, "m1", "11"), (2, "m2", None)], "n int, name string, pubchem_id string")
    again = to_tables(from_texts(spark, {r.file_id: r.text for r in to_text(with_table(t, "a", "Metabolites", wide, "n")).collect()})).kept()
    assert [r.asDict() for r in table_of(again, "a", "Metabolites").collect()] == [{"row": 0, "Metabolite": "m1", "pubchem_id": "11"}, {"row": 1, "Metabolite": "m2", "pubchem_id": ""}]
    assert [r.error for r in again.files.collect()] == [None, None] and len(table_of(again, "b", "Metabolites").collect()) == 2


def test_equal_rows_with_many_columns(spark):
    """Rows of 10,000 columns, compared without gathering any of them; nulls are values."""
    rows = [(0, 0), (1, 1), (2, 0), (3, 2), (4, 1), (5, 0)]
    cells = spark.createDataFrame(rows, "row int, kind int").select("row", F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("pos"), "kind")
    value = F.when((F.col("kind") == 1) & (F.col("pos") == 77), None).when((F.col("kind") == 2) & (F.col("pos") == 77), "").otherwise((F.col("pos") * 7 % 13).cast("string"))
    cells = cells.select(F.lit("f").alias("file_id"), "row", "pos", value.alias("value"))
    got = rules.equal_rows_of_cells(cells, ["file_id"], "row", "pos", "value").collect()
    assert {(r.row, r.first) for r in got} == {(2, 0), (5, 0), (4, 1)}


def test_checks_of_standard_columns(spark):
    """Columns are found by the finders, not by their standard names, and the leftmost of several counts; own finders replace them."""
    def doc(header, *rows):
        old = text()
        start, end = old.index("metabolite_name\t"), old.index("METABOLITES_END")
        return old[:start] + "\n".join((f"metabolite_name\t{header}", *rows)) + "\n" + old[end:]

    docs = {
        "implied": doc("Ret Index", "m1\t1.5", "m2\t2.5"),
        "pair": doc("RI\tri type\tretention index", "m1\t1.5\tx\t1.5", "m2\tNA\ty\t1.6"),
        "fine pair": doc("RI\tri type", "m1\t1.5\tx", "m2\tNA\t-"),
        "other": doc("chemical id\tdatabase identifier type", "m1\tq\tx", "m2\tr\tx"),
        "polarity": doc("Ion Polarity", "m1\tPositive", "m2\tneg"),
        "mode only": doc("ionization mode", "m1\tpositive", "m2\tnegative"),
    }
    t = to_tables(from_texts(spark, docs)).kept()
    found = {}
    for r in issues(t, numbers=(15, 17, 18, 19, 20, 31)).collect():
        found.setdefault(r.file_id, {}).setdefault(r.id, []).append(r.message)
    ids = {k: set(v) for k, v in found.items()}
    assert ids["implied"] == {15, 17} and 'column "Ret Index" needs' in found["implied"][17][0]
    assert 18 in ids["pair"] and '"RI" and "ri type"' in found["pair"][18][0] and 17 not in ids["pair"]
    assert 18 not in ids.get("fine pair", set()) and 17 not in ids.get("fine pair", set())
    assert 19 in ids["other"] and '"chemical id"' in found["other"][19][0]
    assert 31 in ids["polarity"] and 31 not in ids["mode only"]
    assert 'The column "Ion Polarity" at position 2' in found["polarity"][15][0]
    own = {"mine": Finder("mine", has=("ret",), kind="integer")}
    got = [(r.file_id, r.id, r.message) for r in issues(t, numbers=(15, 16, 17, 31), finders=own).collect()]
    assert {(f, i) for f, i, _ in got} == {("implied", 15), ("implied", 16), ("pair", 15), ("pair", 16)}
    assert any("1.5, 2.5" in m for *_, m in got)


def test_commands(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text(text())
    (tmp_path / "in/deep/b.json").write_text(json.dumps(AS_JSON))
    (tmp_path / "in/bad.txt").write_text("what")
    source, out = str(tmp_path / "in"), tmp_path / "out"
    cli.main(["convert", source, str(out / "json"), "--to-format", "json"], spark)
    assert json.loads((out / "json/deep/b.json").read_text()) == AS_JSON and (out / "json/a.txt.json").exists()
    cli.main(["convert", source, str(out / "zip"), "--to-format", "txt", "--compression", "zip"], spark)
    held = {n: zipfile.ZipFile(p).read(n).decode() for p in (out / "zip").glob("*.zip") for n in zipfile.ZipFile(p).namelist()}
    assert held.keys() == {"a.txt", "deep/b.json.txt"} and held["a.txt"] == text()
    cli.main(["convert", source, str(out / "all.zip"), "--to-format", "txt", "--compression", "zip"], spark)  # one archive for all
    assert {n: zipfile.ZipFile(out / "all.zip").read(n).decode() for n in zipfile.ZipFile(out / "all.zip").namelist()} == held
    schema = {"properties": {"PROJECT": {"additionalProperties": False, "properties": {"OTHER": {}}, "minProperties": 3}, "SUBJECT": {"properties": {"SUBJECT_TYPE": {"maxLength": 3}}}}}
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    cli.main(["validate", source, "--to-path", str(out / "issues"), "--silent", "--schema", str(tmp_path / "schema.json")], spark)
    names = {(r.file_id.rsplit("/", 1)[1], r["name"].split(": ")[-1]) for r in spark.read.json(str(out / "issues")).filter("id = 24").collect()}
    assert {("a.txt", "additionalProperties"), ("a.txt", "minProperties"), ("a.txt", "maxLength"), ("b.json", "additionalProperties"), ("b.json", "required")} <= names
    cli.main(["validate", source, "--to-path", str(out / "reports"), "--per-file", "--silent"], spark)
    assert {str(p.relative_to(out / "reports")) for p in (out / "reports").rglob("*.json")} == {"a.txt_validations.json", "deep/b.json_validations.json"}
    assert json.loads((out / "reports/a.txt_validations.json").read_text())[0]["id"] == 24
    cli.main(["extract-metabolites", source, str(out / "counts"), "--to-format", "csv", "--where", "SU:SUBJECT_TYPE=r'Hu.*'"], spark)
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(out / "counts")).collect()} == {("m1", "1", "1", "2"), ("m2", "1", "1", "1")}
    cli.main(["extract-metadata", source, str(out / "values"), "SUBJECT_TYPE", "MS_TYPE"], spark)
    assert {r["key"]: r["values"] for r in spark.read.json(str(out / "values")).collect()} == {"SUBJECT_TYPE": ["Human"], "MS_TYPE": ["ESI"]}
    cli.main(["urls", "b/", "whole", "1", "ST2"], spark)


def test_a_run_leaves_nothing(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    folder.mkdir(parents=True, exist_ok=True)
    before = sorted(os.listdir(folder))
    with run(spark) as own:
        assert shared_folder(spark) == own
        t = to_tables(from_texts(spark, {"a": text()})).kept("files", "cells")
        assert len(issues(t, numbers=(7, 11), store=True).collect()) == 0 and len(os.listdir(own.removeprefix("file://"))) >= 3
    with pytest.raises(ZeroDivisionError), run(spark):
        to_tables(from_texts(spark, {"a": text()})).kept("files")
        raise ZeroDivisionError
    assert sorted(os.listdir(folder)) == before


def test_results_files(spark):
    line = "MS:MS_RESULTS_FILE\tr.txt\tHas m/z:NA"
    t = to_tables(from_texts(spark, {"r": text(items=()).replace("MS:MS_TYPE", line + "\nMS:MS_TYPE")}))
    found = {(r.name.split(": ")[1], r.message.split('"')[1] if "needed" in r.message else "") for r in schema_issues(t).filter("sub_section = 'MS_RESULTS_FILE'").collect()}
    assert ("required", "UNITS") in found and ("not", "") in found


def test_command_line():
    args = cli.parser().parse_args(["extract-metabolites", "in", "out", "--to-format", "csv", "--where", "SU:SUBJECT_TYPE=r'Hu.*'"])
    assert (args.source, args.to_path, args.to_format, args.where) == ("in", "out", "csv", ["SU:SUBJECT_TYPE=r'Hu.*'"])
    assert parse_condition(args.where[0])[1] == re.compile("Hu.*")


def test_addresses(spark):
    assert rest.url("b/", "study", "analysis_id", "AN000001", "whole", "txt", more=("whole",)) == "b/study/analysis_id/AN000001/whole/txt"
    assert rest.url("b/", "gene", "gene_id", "31", ["gene_name", "taxid"]) == "b/gene/gene_id/31/gene_name,taxid"
    assert rest.moverz_url("b/", "MB", 635.52, "M+H", 0.5) == "b/moverz/MB/635.52/M+H/0.5/txt"
    assert rest.exactmass_url("b/", "PC(34:1)", "M+H") == "b/exactmass/PC(34:1)/M+H"
    for bad in (("what", "x", "y", "z"), ("study", "x", "y", "z"), ("study", "analysis_id", "AN1", "data"), ("study", "study_id", "ST1", "x"), ("study", "study_id", "ST1", ["data", "source"])):
        with pytest.raises(ValueError):
            rest.url("b/", *bad)
    with pytest.raises(ValueError):
        rest.moverz_url("b/", "MB", 5, "M+H", 0.5)
    rows = spark.createDataFrame([("1",), ("AN000002",), ("ST3",), ("x",)], "id string")
    assert [r[0] for r in rows.select(rest.document_urls("b/", F.col("id"), "whole")).collect()] == [
        "b/study/analysis_id/AN000001/whole/txt", "b/study/analysis_id/AN000002/whole/txt", "b/study/study_id/ST3/whole/txt", None,
    ]


def test_registered_queries_reach_every_check(spark, tmp_path):
    """Each fault is found in the document that was given it, and the summary counts what the query gives."""
    rows = {
        "customer": ("c_custkey long, c_mktsegment string, c_nationkey int", [(4, "BUILDING", 1), (5, "MACHINERY", 2)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 4), (2, 4), (3, 5), (6, 5)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_discount double, l_quantity double", [(1, 7, 0.1, 3.0), (2, 7, 0.1, 4.0), (1, 8, 0.1, 5.0), (2, 9, 0.1, 6.0), (3, 7, 0.1, 1.0), (6, 8, 0.1, 2.0)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = document_queries.QUERIES["q50_documents_all_issues"](spark, str(tmp_path)).collect()
    ids: dict[str, set[int]] = {}
    for r in got:
        ids.setdefault(r.file_id, set()).add(r.id)
    wrong = {n for n in document_queries.FAULTS if n not in ids.get(f"4-{n}", ())}
    assert set(document_queries.FAULTS) == {*CATALOGUE, 24} and not wrong, wrong
    assert ids["4"] == {24} and ids["5"] - {24} == {7}
    assert any("at home" in r.message or r.sub_section == "EMAIL" for r in got if r.file_id == "4-24")
    assert all(r.section is not None and r.message for r in got)
    counts = {r.file_id: (r.n_issues, r.n_warnings) for r in document_queries.QUERIES["q54_documents_summary"](spark, str(tmp_path)).collect()}
    assert counts == {i: (sum(r.file_id == i for r in got), sum(r.file_id == i and r.severity == "Warning" for r in got)) for i in ids}


def test_combinations_are_tested_once_for_equal_values(spark, monkeypatch):
    """What grows with the documents is tested beside their values, and combinations once for each value, however many documents hold it."""
    rows, keep = {}, schema_tree.stored
    monkeypatch.setattr(schema_tree, "stored", lambda df, name: rows.setdefault(name, []).append(keep(df, name)) or rows[name][-1])
    schema = {"properties": {"A": {"properties": {"K": {"anyOf": [{"enum": ["x"]}, {"pattern": "^y"}]}, "L": {"items": {"not": {"minProperties": 2}, "properties": {"p": {}}}}}}}}
    docs = [{"A": {"K": k, "L": [{"p": 1}, {"p": 1, "q": 2}, {}]}} for k in ("x", "yy", "z", "z", "x", "z")]
    t = to_tables(spark.createDataFrame([(str(i), json.dumps(d), None) for i, d in enumerate(docs)], "file_id string, text string, error string")).kept()
    got = sorted((r.file_id, r.path, r.keyword) for r in schema_tree.broken(t, schema).collect())
    assert got == sorted([(str(i), "/A/K", "anyOf") for i in (2, 3, 5)] + [(str(i), "/A/L/1", "not") for i in range(6)])
    assert rows["tested"][0].filter("of_file = ''").select("held_value").distinct().count() == rows["tested"][0].filter("keyword = 'anyOf'").count() == 3
    assert rows["shapes"][0].count() == 6  # A, K, L, an element, p and q
