"""Rules over any tables: what the checks, the extraction and the queries share. `by` names the columns of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import missing, raw_key

#: Share of one value above which a column is reported.
ONE_VALUE = 0.9


def column_profile(cells: DataFrame, by: list[str], na: tuple[str, ...]) -> DataFrame:
    """by, most (rows of the commonest value), total, kinds (distinct values, null counts as one), nulls and missing; one
    aggregation by value, one by column. Values that are all null or all listed make an empty column, a mix does not."""
    counts = cells.groupBy(*by, "value").agg(F.count("*").alias("n"))
    absent = F.coalesce(F.col("value").isin(*na), F.lit(False))
    return counts.groupBy(*by).agg(
        F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("kinds"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(absent, F.col("n"))), F.lit(0)).alias("missing"),
    )


def null_columns(profile: DataFrame) -> DataFrame:
    return profile.filter("nulls = total OR missing = total")


def one_value_columns(profile: DataFrame, share: float = ONE_VALUE) -> DataFrame:
    """Columns of several values in which one has more than the share of all rows."""
    return profile.filter((F.col("most") / F.col("total") > share) & (F.col("kinds") > 1))


def repeated(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Every occurrence after the first in its group, with its number n."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long")).filter("n > 1")


def equal_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and n of what stands there more than once."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def _alike(cells: DataFrame, by: list[str], row: str, key: list[str], value: str) -> DataFrame:
    """by, row, n (cells) and first of rows that share their fingerprint with others: the first of them with the least row."""
    h = [F.xxhash64(F.lit(seed), *key, F.col(value).isNull(), F.col(value)).cast("decimal(20, 0)") for seed in (0, 1)]
    prints = cells.groupBy(*by, row).agg(F.count("*").alias("n"), F.sum(h[0]).alias("a"), F.sum(h[1]).alias("b"))
    shared = prints.groupBy(*by, "n", "a", "b").agg(F.min(row).alias("first"), F.max(row).alias("last")).filter("first < last").drop("last")
    return prints.join(shared, [*by, "n", "a", "b"]).select(*by, row, "first", "n")


def equal_rows_of_cells(cells: DataFrame, by: list[str], row: str, column: str, value: str, order: str | None = None) -> DataFrame:
    """by, row and first of rows, given as cells, that have the columns and values of an earlier one (the first such).

    A row becomes a fingerprint of 128 bits: two sums of hashes of its cells, which tasks add up in any order, so no row is
    gathered, however many columns it has. Rows that share one are then held against the first of them cell by cell; a row may hold a
    column, and a value in it, several times, so equal cells are counted first. order: a column by whose order a row's cells of one column
    are told apart (the first against the first, and so on); without one, they are equal in any order.
    """
    key = [column]
    if order is not None:  # told apart only where rows are equal in any order
        alike = _alike(cells, by, row, [column], value)
        cells = cells.join(alike.select(*by, row), [*by, row], "left_semi")
        cells = cells.withColumn("nth", F.row_number().over(Window.partitionBy(*by, row, column).orderBy(order))).drop(order)
        key.append("nth")
    again = _alike(cells, by, row, key, value).filter(F.col(row) > F.col("first")).select(*by, row, "first", "n")
    held = cells.groupBy(*by, row, *key, value).agg(F.count("*").alias("times"))
    mine = held.join(again, [*by, row])
    firsts = held.join(again.select(*by, F.col("first").alias(row)).distinct(), [*by, row], "left_semi").withColumnsRenamed({row: "first", value: "other", "times": "others"})
    same = mine.join(firsts, [*by, "first", *key]).filter(F.col(value).eqNullSafe(F.col("other")) & (F.col("times") == F.col("others")))
    return same.groupBy(*by, row, "first", "n").agg(F.sum("times").alias("same")).filter("same = n").select(*by, row, "first")


def blank(rows: DataFrame, column: str, na: tuple[str, ...]) -> DataFrame:
    return rows.filter(missing(F.col(column), na))


def header_like(rows: DataFrame, column: str, headers: tuple[str, ...]) -> DataFrame:
    """Rows whose value is one of the headers, whatever its case."""
    return rows.filter(F.lower(column).isin(*headers))


def not_in(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner; a null key has none."""
    return rows.join(other.select(*on), on, "left_anti")


def one_side(rows: DataFrame, by: list[str], left: Column, right: Column) -> DataFrame:
    """by and side (left or right) of what stands on one side only, by one aggregation over both."""
    sides = rows.groupBy(*by).agg(F.bool_or(left).alias("l"), F.bool_or(right).alias("r")).filter("l <> r")
    return sides.select(*by, F.when(F.col("l"), "left").otherwise("right").alias("side"))


def mismatched(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, how: str = "full_outer") -> DataFrame:
    """Partners whose values a and b differ, null being a value; with a full join, what has no partner differs from null."""
    return left.join(right, on, how).filter(~F.col(a).eqNullSafe(F.col(b)))


def both_values(rows: DataFrame, by: list[str], one: Column, other: Column) -> DataFrame:
    """The groups in which both conditions hold for some row."""
    return rows.groupBy(*by).agg(F.bool_or(one).alias("one"), F.bool_or(other).alias("other")).filter("one AND other").drop("one", "other")


def unlike_masks(rows: DataFrame, one: Column, other: Column) -> DataFrame:
    """Rows for which one condition holds and the other does not."""
    return rows.filter(one != other)


def tag_counts(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, tag, n and n_warnings of issues(severity, tags)."""
    rows = found.select(*(by or []), "severity", F.explode("tags").alias("tag"))
    return rows.groupBy(*(by or []), "tag").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Warning").alias("n_warnings"))


def carried(rows: DataFrame, by: list[str], order: str, value: Column) -> Column:
    """The last value that is not null, up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def joined_values(rows: DataFrame, by: list[str], order: str, value: str, between: str = " ") -> DataFrame:
    """by and value: a group's values as one text, in order (nulls first, then by value); null where all are."""
    parts = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return rows.groupBy(*by).agg(F.when(F.size(parts) > 0, F.array_join(parts[value], between)).alias(value))


def numbered_keys(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """rows with raw_key: the key, with its number where it stands in the group before."""
    dup = F.row_number().over(Window.partitionBy(*by, key).orderBy(order)) - 1
    return rows.withColumn("dup", dup).withColumn("raw_key", raw_key(F.col(key), F.col("dup"))).drop("dup")


def value_sets(items: DataFrame) -> DataFrame:
    """key and the sorted set of its values, of items(key, value)."""
    return items.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))


def in_order(rows: DataFrame, column: str, order: tuple[str, ...], by: list[str], then: str) -> DataFrame:
    """rows with pos, the place in the group: values as listed, others behind them, and then by another column."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    along = Window.partitionBy(*by).orderBy(F.when(at > 0, at).otherwise(len(order) + 1), then)
    return rows.withColumn("pos", F.row_number().over(along).cast("long"))


def to_cells(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column and value (a string, empty for null) of each of the columns."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    return wide.select(*keys, *as_text).unpivot(keys, columns, "column", "value")


def to_wide(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each of the keys with a column for each name: the first value there, null if there is none."""
    return cells.groupBy(*keys).pivot("column", columns).agg(F.first("value", ignorenulls=True))
