"""One document's table as a wide DataFrame, and back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import raw_key
from assayspark.model import TABLES, Tables
from assayspark.operators.rules import to_wide


def table_of(t: Tables, file_id: str, table: str) -> DataFrame:
    """row, and a column for each column of a document's table, in order; of columns with one name, the later ones carry a
    number. Without such a table there are no rows and no further columns. The names (of one document) come to the driver."""
    if table not in TABLES:
        raise ValueError(f"{table} is none of {', '.join(TABLES)}")
    mine = (F.col("file_id") == file_id) & (F.col("tbl") == table)
    name = raw_key(F.col("column"), F.col("dup"))
    heads = t.headers.filter(mine).select("pos", name.alias("name")).orderBy("pos").collect()
    names = list(dict.fromkeys(h["name"] for h in heads))
    cells = t.cells.filter(mine).select("row", name.alias("column"), "value")
    return to_wide(cells, ["row"], names).select("row", *(F.col(f"`{n.replace('`', '``')}`") for n in names)).orderBy("row")


def with_table(t: Tables, file_id: str, table: str, wide: DataFrame, order: str) -> Tables:
    """The tables, with a document's table replaced by a wide DataFrame: its rows in the order of one column (which is left
    out), its first other column as the name, all values as strings and null as empty. The document may lack the table; it stands in
    its data section, so it needs one."""
    if table not in TABLES:
        raise ValueError(f"{table} is none of {', '.join(TABLES)}")
    spark, columns = wide.sparkSession, [c for c in wide.columns if c != order]
    names = ["Metabolite", *columns[1:]] if columns else []
    each = F.posexplode(F.array(*(F.coalesce(F.col(f"`{c.replace('`', '``')}`").cast("string"), F.lit("")) for c in columns)).cast("array<string>"))
    rows = wide.withColumn("row", (F.row_number().over(Window.partitionBy(F.lit(file_id)).orderBy(order)) - 1).cast("int"))  # one document's
    cells = rows.select("row", each.alias("pos", "value")).select(
        F.lit(file_id).alias("file_id"), F.lit(table).alias("tbl"), "row", "pos", F.col("pos").alias("at"), F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("pos")).alias("column"), F.lit(0).alias("dup"), "value", F.lit(False).alias("raw")
    )
    heads = spark.createDataFrame([(file_id, table, i, c, n, 0, True) for i, (c, n) in enumerate(zip(columns, names, strict=True))], t.headers.schema)
    others = ~((F.col("file_id") == file_id) & (F.col("tbl") == table))
    block = t.files.filter((F.col("file_id") == file_id) & F.col("data_section").isNotNull())
    block = block.select("file_id", F.col("data_section").alias("section"), F.lit(table).alias("tbl"), F.lit(False).alias("overflow"))
    return replace(t, cells=t.cells.filter(others).unionByName(cells), headers=t.headers.filter(others).unionByName(heads), blocks=t.blocks.filter(others).unionByName(block))
