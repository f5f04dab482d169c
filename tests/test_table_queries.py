"""Every query over tables against its SQL in DuckDB, and those without SQL against plain Python."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from assayspark.plans import table_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(table_queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = table_queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
    result = duck.execute(table_queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(row[i]) for i in places]) for row in result.fetchall())


def test_wrapped_lines(spark, duck):
    got: dict[tuple, list[str]] = {}
    for row in sorted(table_queries.QUERIES["q35_render_lines"](spark, FOLDER).collect(), key=lambda r: (r.conv_id, r.turn, r.line_no)):
        got.setdefault((row.conv_id, row.turn), []).append(row.line)
    texts = duck.execute("SELECT conv_id, turn, text FROM conversations").fetchall()
    assert len(got) == len({t[:2] for t in texts})
    for conv_id, turn, text in texts:
        lines = got[conv_id, turn]
        assert " ".join(lines) == text
        assert all(len(line) <= 80 or " " not in line for line in lines)
        assert all(len(a) + 1 + len(b.split(" ")[0]) > 80 for a, b in zip(lines, lines[1:], strict=False))


def test_whole_texts_are_joined(spark, tmp_path):
    rows = [(1, 2, "user", "x" * 50 + "b"), (1, 0, "user", "y" * 30 + "a"), (1, 1, "assistant", "z" * 25), (2, 0, "user", None), (2, 0, None, "w" * 21), (2, 3, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.role): r.value for r in table_queries.QUERIES["q27_concat_items"](spark, str(tmp_path)).collect()}
    assert got == {(1, "user"): "y" * 30 + "a " + "x" * 50 + "b", (1, "assistant"): "z" * 25, (2, "user"): None, (2, None): "w" * 21}


def test_sides_over_all_lines(spark, tmp_path):
    parts = [(1, "both ", 3), (2, " a", 30), (3, "r", 25), (4, "both", 26), (5, None, None)]
    lines = [(10, 1, 5, 3.0, "A"), (11, 4, 2, 1.0, "R"), (11, 2, 1, 50.0, "A"), (12, 3, 7, 2.0, "R"), (13, 2, 1, 50.0, "N"), (14, 1, 1, 46.0, "A"), (14, 5, 1, 1.0, "A")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.side, r["item"], r["value"]) for r in table_queries.QUERIES["q46_anti_items_all_lines"](spark, str(tmp_path)).collect()}
    assert got == {("only_a", "name", "a"), ("only_r", "name", "r"), ("only_a", "name", None), ("only_a", "order", "10"), ("only_r", "order", "12"), ("only_a", "order", "14")}
    assert {(r.side, r["name"]) for r in table_queries.QUERIES["q10_anti_names_both_directions"](spark, str(tmp_path)).collect()} == {("only_a", "a"), ("only_r", "r"), ("only_a", None)}
    assert {r.p_size for r in table_queries.QUERIES["q21_value_integer"](spark, str(tmp_path)).collect()} == {3, 30, 25, 26}
