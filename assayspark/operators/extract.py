"""Metabolites and metadata values of all documents, with conditions on their items."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import positive
from assayspark.model import HEADER, Tables, stored
from assayspark.operators.rules import value_sets

#: Two-letter codes of conditions such as `SU:SUBJECT_TYPE`. Fixed values.
SECTIONS = {
    "PR": "PROJECT", "ST": "STUDY", "SU": "SUBJECT", "CO": "COLLECTION", "TR": "TREATMENT", "SP": "SAMPLEPREP",
    "CH": "CHROMATOGRAPHY", "AN": "ANALYSIS", "MS": "MS", "NM": "NM", "MW": HEADER,
}


@dataclass(frozen=True)
class ItemIs:
    """Documents whose item `SEC:KEY` equals the value; those without the item don't match."""

    full_key: str
    value: str

    def files(self, items: DataFrame) -> DataFrame:
        code, _, key = self.full_key.partition(":")
        rows = items.filter((F.col("section") == SECTIONS.get(code, code)) & (F.col("key") == key))
        return rows.filter(self._holds()).select("file_id").distinct()

    def _holds(self):
        return F.col("value") == self.value


class ItemLike(ItemIs):
    """As ItemIs, for values in which the pattern is found."""

    def _holds(self):
        return F.col("value").rlike(self.value)


@dataclass(frozen=True)
class ItemWhere(ItemIs):
    """As ItemIs, for values that a condition of the caller's own holds for: a function of the value's column."""

    value: Callable[[Column], Column]

    def _holds(self):
        return self.value(F.col("value"))


def matchers(conditions: list[tuple[str, str | re.Pattern | Callable[[Column], Column]]]) -> list[ItemIs]:
    """A compiled pattern makes a search, a string an equality, a function a condition of its own."""
    return [ItemLike(k, v.pattern) if isinstance(v, re.Pattern) else ItemWhere(k, v) if callable(v) else ItemIs(k, v) for k, v in conditions]


def parse_condition(text: str) -> tuple[str, str | re.Pattern]:
    """`SEC:KEY=value`, or `SEC:KEY=r'pattern'`."""
    key, _, value = text.partition("=")
    return (key, re.compile(value[2:-1])) if value.startswith("r'") else (key, value)


def matching(files: DataFrame, items: DataFrame, conditions: list[ItemIs]) -> DataFrame:
    """The files that fulfil every condition."""
    for c in conditions:
        files = files.join(c.files(items), "file_id", "left_semi")
    return files


def measurements(t: Tables, conditions: list[ItemIs] | None = None, values: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """metabolite, study_id, analysis_id and sample_id of every positive measurement, once each. values: gives, of the files with a file_id, the
    cells beside their rows' metabolites (as parse_text.text_values does), in place of t.cells, which are joined for that; it may then
    leave all other documents unread."""
    files = matching(t.files.filter("error IS NULL"), t.items, conditions or []).select("file_id")
    ids = t.items.filter(F.col("section") == HEADER).groupBy("file_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.lower()) for k in ("STUDY_ID", "ANALYSIS_ID")))
    if values is not None:
        wanted = stored(files.distinct().join(ids, "file_id", "left"), "wanted")
        rows = values(wanted.select("file_id")).filter("tbl = 'Data' AND column <> 'Metabolite' AND dup = 0").filter(positive(F.col("value")))
        return rows.join(wanted, "file_id").select("metabolite", "study_id", "analysis_id", F.col("column").alias("sample_id")).distinct()
    cells = t.cells.filter("tbl = 'Data'")
    names = cells.filter("column = 'Metabolite' AND dup = 0").select("file_id", "row", F.col("value").alias("metabolite"))
    # of a sample that has several columns, the first is read
    values = cells.filter("column <> 'Metabolite' AND dup = 0").filter(positive(F.col("value"))).select("file_id", "row", F.col("column").alias("sample_id"))
    rows = values.join(names, ["file_id", "row"]).join(files, "file_id", "left_semi").join(ids, "file_id", "left")
    return rows.select("metabolite", "study_id", "analysis_id", "sample_id").distinct()


#: Measurements that a task counts, where their number is known.
COUNTED_AT_ONCE = 250_000


def metabolite_counts(found: DataFrame, most: int | None = None) -> DataFrame:
    """metabolite_name, num-studies, num_analyses and num_samples; each level sums the one below it. most: found may hold measurements
    several times, about so many rows; they are dealt by metabolite and study, so that a task has about COUNTED_AT_ONCE of them
    however many there are, and all levels but the last follow there without a further shuffle."""
    if most is not None:
        parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // COUNTED_AT_ONCE + 1)
        found = found.select("metabolite", "study_id", "analysis_id", "sample_id").repartition(parts, "metabolite", "study_id").distinct()
    analyses = found.groupBy("metabolite", "study_id", "analysis_id").agg(F.count("*").alias("n"))
    studies = analyses.groupBy("metabolite", "study_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return studies.groupBy(F.col("metabolite").alias("metabolite_name")).agg(F.count("*").alias("num-studies"), F.sum("k").alias("num_analyses"), F.sum("n").alias("num_samples"))


def metabolite_samples(found: DataFrame) -> DataFrame:
    """metabolite, study_id, analysis_id and its sorted samples."""
    return found.groupBy("metabolite", "study_id", "analysis_id").agg(F.sort_array(F.collect_set("sample_id")).alias("samples"))


def metadata(t: Tables, keys: list[str]) -> DataFrame:
    """key and the sorted set of its values over all documents and sections."""
    rows = t.items.filter(F.col("key").isin(*keys)).join(t.files.filter("error IS NULL"), "file_id", "left_semi")
    return value_sets(rows)


def write_metabolites_csv(counts: DataFrame, path: str, header: bool = True) -> None:
    counts.write.mode("overwrite").option("header", header).csv(path)


def write_metadata_csv(found: DataFrame, path: str, header: bool = True) -> None:
    """Each key with its values, all quoted, under the names value0, value1 and so on."""
    most = found.agg(F.max(F.size("values"))).first()[0] or 0
    wide = found.select(F.col("key").alias("metadata"), *(F.coalesce(F.get("values", F.lit(i)), F.lit("")).alias(f"value{i}") for i in range(most)))
    wide.write.mode("overwrite").option("header", header).option("quoteAll", True).csv(path)


def write_json(found: DataFrame, path: str) -> None:
    """One JSON line for each key or metabolite, in order."""
    found.orderBy(found.columns[0]).write.mode("overwrite").json(path)
