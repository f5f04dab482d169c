"""Rows as cells, in which a column may stand several times."""

from assayspark.operators import rules
from assayspark.plans.document_queries import equal_rows_of_cells


def test_columns_that_repeat_in_a_row(spark):
    rows = {1: [(1, "A"), (1, "A"), (2, "B")], 2: [(2, "B"), (1, "A"), (1, "A")], 3: [(1, "A"), (2, "B"), (2, "B")], 4: [(1, "R"), (1, None)], 5: [(1, None), (1, "R")], 6: [(1, "R"), (1, "R")], 7: [(1, "A"), (2, "B")]}
    cells = spark.createDataFrame([(0, row, *cell) for row, held in rows.items() for cell in held], "g int, row int, col int, value string")
    assert {tuple(r) for r in rules.equal_rows_of_cells(cells, ["g"], "row", "col", "value").collect()} == {(0, 2, 1), (0, 5, 4)}


def test_columns_that_repeat_in_order(spark):
    rows = {1: [(1, "A"), (1, "R"), (2, "B")], 2: [(1, "R"), (1, "A"), (2, "B")], 3: [(2, "B"), (1, "A"), (1, "R")], 4: [(1, "R"), (2, "B"), (1, "A")], 5: [(1, None), (1, "R")], 6: [(1, "R"), (1, None)], 7: [(1, None), (1, "R")]}
    cells = spark.createDataFrame([(0, row, *cell, at) for row, held in rows.items() for at, cell in enumerate(held)], "g int, row int, col int, value string, at int").repartition(3)
    assert {tuple(r) for r in rules.equal_rows_of_cells(cells, ["g"], "row", "col", "value", "at").collect()} == {(0, 3, 1), (0, 4, 2), (0, 7, 5)}


def test_lines_of_one_number(spark, tmp_path):
    """Order 2 has the lines of order 1 in another order, order 3 in the same one."""
    spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(2, 1, "R"), (1, 1, "A"), (3, 2, "N"), (1, 2, "N"), (3, 1, "A"), (2, 1, "A"), (1, 1, "R"), (2, 2, "N"), (3, 1, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in equal_rows_of_cells(spark, str(tmp_path)).collect()] == [(7, 3, 1)]
