"""The numbered checks as plans over the tables; each gives rows of one issues table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import missing
from assayspark.functions.finders import FINDERS, Finder, may_hold
from assayspark.functions.na import COLUMN_NA, METABOLITE_NA, SCHEMA_NA
from assayspark.model import TABLES, Tables, stored
from assayspark.operators import rules

#: Names of headers that turn up as metabolite names. Fixed values.
HEADER_LIKE = ("metabolite_name", "metabolite name", "samples", "factors", "bin range(ppm)")
#: Columns that another column must go with. Fixed values.
IMPLIED = {"other_id": "other_id_type", "retention_index": "retention_index_type"}
POSITIVE, NEGATIVE = ("pos", "positive", "+"), ("neg", "negative", "-")

#: Number: name, severity and tags. Fixed values.
CATALOGUE: dict[int, tuple[str, str, tuple[str, ...]]] = {
    1: ("Duplicate Sub-section", "Error", ("consistency",)),
    2: ("Bad Headers", "Error", ("consistency",)),
    3: ("Factor Mismatch", "Error", ("consistency",)),
    4: ("Duplicate Sample ID in SSF", "Warning", ("value",)),
    5: ("Duplicate Factors in SSF", "Warning", ("value",)),
    6: ("Duplicate Additional Data", "Warning", ("value",)),
    7: ("Missing Sample ID(s) in SSF", "Error", ("consistency",)),
    8: ("Duplicate Samples in DATA", "Warning", ("value",)),
    9: ("Metabolite(s) in DATA not METABOLITES", "Error", ("consistency",)),
    10: ("Blank Metabolite(s) in DATA", "Error", ("value",)),
    11: ("Duplicate Metabolite(s) in DATA", "Warning", ("value",)),
    12: ("Metabolite(s) in METABOLITES not DATA", "Error", ("consistency",)),
    13: ("Blank Metabolite(s) in METABOLITES", "Error", ("value",)),
    14: ("Duplicate Metabolite(s) in METABOLITES", "Warning", ("value",)),
    15: ("Standard Column Name Match", "Warning", ("value",)),
    16: ("METABOLITES Bad Standard Values", "Warning", ("value",)),
    17: ("Missing Implied Column", "Warning", ()),
    18: ("Paired Columns Value Mismatch", "Warning", ()),
    19: ('"other_id" Column', "Warning", ()),
    20: ("Multiple Standard Name Match", "Warning", ()),
    21: ('Missing "sample_id" in EXTENDED', "Error", ("format",)),
    22: ("Missing Sample ID(s) in EXTENDED", "Error", ("consistency",)),
    23: ("Bad Metabolite Name", "Warning", ("value",)),
    25: ("Inconsistent Columns", "Error", ("consistency",)),
    26: ("Column With No Name", "Error", ("value",)),
    27: ("Null Column", "Warning", ("value",)),
    28: ("Possible Bad Column Values", "Warning", ("value",)),
    29: ("Duplicate Rows", "Warning", ("value",)),
    30: ("Duplicate Column Names", "Warning", ("value",)),
    31: ("Multiple Polarities", "Error", ("format",)),
    32: ("No MS or NM Section", "Error", ("format",)),
    33: ("Missing METABOLITES Section", "Warning", ("format",)),
    34: ("Missing Header", "Error", ("format",)),
    35: ("Blank Sample ID(s) in EXTENDED", "Error", ("value",)),
    36: ("Blank Metabolite(s) in EXTENDED", "Error", ("value",)),
}
#: The order in which checks report.
ORDER = (24, 32, 4, 5, 6, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 33, 21, 22, 35, 36, 23, 34, 25, 26, 27, 28, 29, 30, 31, 2, 1)
ISSUE = "file_id string, id int, name string, severity string, tags array<string>, section string, sub_section string, message string"

CHECKS: dict[int, Callable[..., DataFrame]] = {}
#: Checks that also take the column finders.
BY_FINDERS: set[int] = set()
#: Checks of metabolites' names, of standard columns, and all that look at cells. Fixed values.
OF_LISTS = {9, 10, 11, 12, 13, 14, 21, 23, 33, 36}
OF_STANDARDS = {15, 16, 17, 18, 19, 20, 31}
OF_CELLS = OF_LISTS | {16, 18, 22, 25, 27, 28, 29, 31, 35}


def check(number: int, by_finders: bool = False):
    def register(function):
        CHECKS[number] = function
        if by_finders:
            BY_FINDERS.add(number)
        return function

    return register


def issue(rows: DataFrame, n: int, section: str | Column, sub_section: str | Column, message: str | Column) -> DataFrame:
    """rows(file_id, ...) as issues with the number n."""
    name, severity, tags = CATALOGUE[n]
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "file_id", F.lit(n).alias("id"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"),
        lit(section).alias("section"), lit(sub_section).alias("sub_section"), F.concat(F.lit(f"{severity}: "), lit(message)).alias("message"),
    )


@dataclass
class Shared(Tables):
    """Tables with what several checks read; issues() makes it, and writes it to the shared folder where it stores.

    digest:   file_id, tbl, names, columns, equal_rows    one row for each grid, see digest()
    lists:    file_id, Data, Metabolites, Extended        the metabolites of each table's rows (row and name, in order); null without the table
    standard: as standard_columns()
    """

    digest: DataFrame | None = None
    lists: DataFrame | None = None
    standard: DataFrame | None = None

    @property
    def loose(self) -> DataFrame:
        """The cells that are in no digest."""
        return self.cells if self.others is None else self.others


def digest(grids: DataFrame) -> DataFrame:
    """file_id, tbl, names (row and name), columns (pos, column, dup, empty, uniform and the values of rows) and equal_rows of grids: what checks look for in cells,
    found within a table's row. Of Data, whose columns are samples, only the columns that a check reports are kept, without values."""
    n = F.size("values")
    count = lambda ordered, x: F.size(ordered) - F.size(F.array_remove(ordered, x))
    middle = lambda ordered: F.get(ordered, F.floor(n / 2).cast("int"))
    last = lambda ordered: F.get(ordered, n - 1)
    # a value that most rows have stands in the middle, too
    uniform = lambda ordered: (count(ordered, middle(ordered)) / n > rules.ONE_VALUE) & (F.get(ordered, F.lit(0)) != last(ordered))
    empty = lambda ordered: last(ordered).isin(*COLUMN_NA) & F.forall(ordered, lambda x: x.isin(*COLUMN_NA))

    def column(name: Column, i: Column) -> Column:
        values = F.transform("values", lambda row: F.get(row, i))
        found = lambda values, ordered: F.struct(
            i.alias("pos"), name.alias("column"), F.get("dups", i).alias("dup"), ((name != "Metabolite") & empty(ordered)).alias("empty"), ((name != "Metabolite") & uniform(ordered)).alias("uniform"),
            F.when(F.col("tbl") != "Data", values).alias("values"),
        )
        return F.transform(F.transform(F.array(values), lambda v: F.struct(v.alias("v"), F.sort_array(v).alias("ordered"))), lambda x: found(x["v"], x["ordered"]))[0]

    columns = F.filter(F.transform("names", column), lambda c: (F.col("tbl") != "Data") | c["empty"] | c["uniform"])
    names = F.transform("values", lambda row, i: F.struct(i.alias("row"), F.get(row, F.lit(0)).alias("name")))
    whole = F.transform("values", lambda row: F.array_join(row, "\t"))  # no value holds a tab
    return grids.select("file_id", "tbl", names.alias("names"), columns.alias("columns"), (F.size(F.array_distinct(whole)) < n).alias("equal_rows"))


def _lists(digest: DataFrame | None, loose: DataFrame) -> DataFrame:
    """Shared.lists."""
    named = loose.filter(F.col("column").isin("Metabolite", "metabolite_name") & (F.col("dup") == 0)).groupBy("file_id", "tbl", "row").agg(F.min_by("value", "pos").alias("name"))
    rows = loose.select("file_id", "tbl").distinct().join(named, ["file_id", "tbl"], "left").groupBy("file_id", "tbl")
    rows = rows.agg(F.sort_array(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "name")))).alias("names"))
    if digest is not None:
        rows = rows.unionByName(digest.select("file_id", "tbl", "names"))
    return rows.groupBy("file_id").agg(*(F.first(F.when(F.col("tbl") == x, F.col("names")), ignorenulls=True).alias(x) for x in TABLES))


def shared(t: Tables, finders: dict[str, Finder] | None = None, numbers: tuple[int, ...] | None = None, store: bool = False) -> Shared:
    """t with what the checks of these numbers share."""
    keep = stored if store else lambda df, name: df
    out = Shared(*(getattr(t, f.name) for f in fields(Tables)))
    out.with_grids(t.grids, t.others)
    wanted = lambda some: numbers is None or bool(some & set(numbers))
    if t.grids is not None and wanted(OF_CELLS):
        out.digest = keep(digest(t.grids), "digest")
        out.others = keep(t.others, "others")
    if wanted(OF_LISTS):
        out.lists = keep(_lists(out.digest, out.loose), "lists")
    if wanted(OF_STANDARDS):
        out.standard = keep(standard_columns(t, finders), "standard")
    return out


def cells_of(t: Shared, table: str, places: DataFrame | None = None, on: str = "pos") -> DataFrame:
    """file_id, row, pos, column, dup and value: the cells of a table that is not Data; places: only those, by file_id and on, with their further columns."""
    rest = t.loose.filter(F.col("tbl") == table).select("file_id", "row", "pos", "column", "dup", "value")
    join = lambda df: df if places is None else df.join(places.drop(*({"column", "dup"} - {on})), ["file_id", on])
    if t.digest is None:
        return join(rest)
    grids = join(t.digest.filter(F.col("tbl") == table).select("file_id", F.explode("columns").alias("c")).select("file_id", "c.pos", "c.column", "c.dup", "c.values"))
    cells = grids.select("*", F.posexplode("values").alias("row", "value")).drop("values")
    return cells.unionByName(join(rest))


def names(t: Shared, table: str) -> DataFrame:
    """file_id, row and name: the metabolite of each row of a table."""
    return t.lists.select("file_id", F.inline(table))


def _named(t: Shared, *tables: str) -> DataFrame:
    """file_id, x and y: the metabolites of one or two tables, for documents that have the first of them."""
    both = (F.coalesce(F.col(n)["name"], F.array().cast("array<string>")).alias(a) for n, a in zip(tables, "xy", strict=False))
    return t.lists.filter(F.col(tables[0]).isNotNull()).select("file_id", *both)


def _absent(rows: DataFrame) -> DataFrame:
    """file_id and found: of rows(file_id, x, y), the names (stripped) of x that are not in y, as listed() has them; a null name never is."""
    rows = rows.select("file_id", *(F.transform(c, lambda v: F.trim(v)).alias(c) for c in "xy"))
    rows = rows.select("file_id", "x", F.sort_array(F.array_except(F.array_compact("x"), "y")).alias("absent"))
    return rows.filter((F.size("absent") > 0) | F.exists("x", F.isnull)).select("file_id", F.array_join("absent", ", ").alias("found"))


def _several(rows: DataFrame) -> DataFrame:
    """file_id and found: of rows(file_id, x), the names that stand in x more than once, as listed() has them."""
    rows = rows.filter(F.size(F.array_distinct("x")) < F.size("x")).select("file_id", F.sort_array(F.array_compact("x")).alias("x"))
    return rows.select("file_id", F.array_join(F.array_distinct(F.filter("x", lambda v, i: v == F.get("x", i - 1))), ", ").alias("found"))


def _with_blank(rows: DataFrame) -> DataFrame:
    """file_id of rows(file_id, x) that have a name which is missing."""
    return rows.filter(F.exists("x", lambda v: missing(v, METABOLITE_NA))).select("file_id")


def listed(rows: DataFrame, value: str) -> DataFrame:
    """file_id and found: the sorted distinct values as one text."""
    return rows.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_set(value)), ", ").alias("found"))


def repeated(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Every occurrence of a value after its first in the document."""
    return rules.repeated(rows, ["file_id", value], order)


def column_text(column: str | Column, position: Column, dup: Column | None = None) -> Column:
    """How messages name a column: which of several of its name it is, and its position from 1."""
    name = F.col(column) if isinstance(column, str) else column
    which = F.lit("")
    if dup is not None:
        n = dup + 1
        ends = F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
        which = F.when(dup > 0, F.concat(n.cast("string"), ends, F.lit(" "))).otherwise("")
    return F.concat(F.lit("The "), which, F.lit('column "'), name, F.lit('" at position '), position.cast("string"))


@check(1)
def duplicate_sub_section(t: Tables) -> DataFrame:
    return issue(t.items.filter("repeated"), 1, F.col("section"), F.col("key"), F.concat(F.lit("The sub-section, "), "key", F.lit(", is given twice with the same value.")))


@check(2)
def bad_headers(t: Tables) -> DataFrame:
    return issue(t.blocks.filter("overflow"), 2, F.col("section"), F.col("tbl"), "A row has more cells than the header has names.")


@check(3)
def factor_mismatch(t: Tables) -> DataFrame:
    """Factors repeated in a data table against those of the samples; of a sample given twice, the last counts."""
    last = Window.partitionBy("file_id", "sample_id").orderBy(F.desc("idx"))
    samples = t.factors.select("file_id", "sample_id").distinct()
    ssf = t.ssf.join(samples, ["file_id", "sample_id"], "left_semi")
    ssf = ssf.withColumn("n", F.row_number().over(last)).filter("n = 1").select("file_id", "sample_id", F.explode("factors").alias("f"))
    ssf = ssf.select("file_id", "sample_id", F.col("f.key").alias("key"), F.col("f.value").alias("ssf_value"))
    both = rules.mismatched(t.factors, ssf, ["file_id", "sample_id", "key"], "value", "ssf_value")
    return issue(both.select("file_id").distinct(), 3, "SUBJECT_SAMPLE_FACTORS", "Factors", "The factors in the data table differ from those of the samples.")


@check(4)
def duplicate_samples(t: Tables) -> DataFrame:
    rows = repeated(t.ssf.filter("coalesce(sample_id, '') <> ''"), "sample_id", "idx")
    return issue(rows, 4, "SUBJECT_SAMPLE_FACTORS", F.concat(F.lit("row "), F.col("idx") + 1), F.concat(F.lit("The sample ID, "), "sample_id", F.lit(", is given more than once.")))


@check(5)
def duplicate_factors(t: Tables) -> DataFrame:
    rows = t.ssf.filter(F.exists("factors", lambda x: x["dup"] > 0))
    return issue(rows, 5, "SUBJECT_SAMPLE_FACTORS", F.concat(F.lit("row "), F.col("idx") + 1), F.concat(F.lit("A factor is given more than once for the sample "), "sample_id", F.lit(".")))


@check(6)
def duplicate_additional(t: Tables) -> DataFrame:
    rows = t.ssf.filter(F.exists("additional", lambda x: x["dup"] > 0))
    return issue(rows, 6, "SUBJECT_SAMPLE_FACTORS", F.concat(F.lit("row "), F.col("idx") + 1), F.concat(F.lit("Additional data is given more than once for the sample "), "sample_id", F.lit(".")))


def _data_samples(t: Tables) -> DataFrame:
    return t.headers.filter("tbl = 'Data' AND pos > 0 AND named").select("file_id", F.col("column").alias("sample_id"), "dup")


@check(7)
def samples_not_in_ssf(t: Tables) -> DataFrame:
    rows = rules.not_in(_data_samples(t), t.ssf, ["file_id", "sample_id"])
    return issue(listed(rows, "sample_id"), 7, "Data", "Data", F.concat(F.lit("Sample IDs without factors: "), "found"))


@check(8)
def duplicate_data_samples(t: Tables) -> DataFrame:
    return issue(listed(_data_samples(t).filter("dup > 0"), "sample_id"), 8, "Data", "Data", F.concat(F.lit("Samples with several columns: "), "found"))


@check(9)
def data_not_in_metabolites(t: Shared) -> DataFrame:
    rows = _absent(_named(t, "Data", "Metabolites")).join(t.files.filter("data_section <> 'NMR_BINNED_DATA'"), "file_id", "left_semi")
    return issue(rows, 9, "Data", "Data", F.concat(F.lit("Metabolites that METABOLITES doesn't have: "), "found"))


@check(10)
def blank_in_data(t: Shared) -> DataFrame:
    return issue(_with_blank(_named(t, "Data")), 10, "Data", "Data", "A metabolite has no name.")


@check(11)
def repeated_in_data(t: Shared) -> DataFrame:
    return issue(_several(_named(t, "Data")), 11, "Data", "Data", F.concat(F.lit("Metabolites given more than once: "), "found"))


@check(12)
def metabolites_not_in_data(t: Shared) -> DataFrame:
    return issue(_absent(_named(t, "Metabolites", "Data")), 12, "Data", "Metabolites", F.concat(F.lit("Metabolites that the data doesn't have: "), "found"))


@check(13)
def blank_in_metabolites(t: Shared) -> DataFrame:
    return issue(_with_blank(_named(t, "Metabolites")), 13, "Data", "Metabolites", "A metabolite has no name.")


@check(14)
def repeated_in_metabolites(t: Shared) -> DataFrame:
    return issue(_several(_named(t, "Metabolites")), 14, "Data", "Metabolites", F.concat(F.lit("Metabolites given more than once: "), "found"))


def standard_names_of(name: Column, finders: dict[str, Finder] | None = None) -> Column:
    """A row for each standard column that a name (stripped, in lower case) could mean."""
    found = F.array(*(F.when(f.names(name), F.lit(n)) for n, f in (finders or FINDERS).items()))
    return F.explode(F.array_compact(found))


def standard_columns(t: Tables, finders: dict[str, Finder] | None = None) -> DataFrame:
    """file_id, column, dup, pos, c and standard: which columns of METABOLITES tables mean which standard column. Each name is
    held against the finders once, however many documents have it."""
    heads = t.headers.filter("tbl = 'Metabolites' AND column <> 'Metabolite'").withColumn("c", F.lower(F.trim("column")))
    found = heads.select("c").distinct().select("c", standard_names_of(F.col("c"), finders).alias("standard"))
    return heads.select("file_id", "column", "dup", "pos", "c").join(found, "c")


def first_columns(found: DataFrame) -> DataFrame:
    """file_id, standard, column and pos: the leftmost column that means each standard column."""
    first = found.groupBy("file_id", "standard").agg(F.min_by(F.struct("column", "pos"), "pos").alias("x"))
    return first.select("file_id", "standard", "x.column", "x.pos")


@check(15)
def standard_names(t: Shared) -> DataFrame:
    found = t.standard
    has = t.headers.filter("tbl = 'Metabolites'").select("file_id", F.col("column").alias("standard"))
    rows = rules.not_in(found.filter("lower(column) <> standard"), has, ["file_id", "standard"])
    return issue(rows, 15, "Data", "Metabolites", F.concat(column_text("column", F.col("pos") + 1, F.col("dup")), F.lit(' looks like the standard column "'), "standard", F.lit('".')))


@check(16, by_finders=True)
def standard_values(t: Shared, finders: dict[str, Finder] | None = None) -> DataFrame:
    """Each distinct value of a standard column is tested once, all of them in one pass; then they are counted for their columns."""
    cells = cells_of(t, "Metabolites", t.standard.select("file_id", "pos", "standard"))
    values = cells.select("standard", "value").distinct()
    bad = values.filter(~may_hold(F.col("standard"), F.col("value"), finders or FINDERS))
    rows = cells.join(bad, ["standard", "value"]).groupBy("file_id", "column", "dup", "pos", "standard").agg(F.array_join(F.sort_array(F.collect_set("value")), ", ").alias("found"))
    return issue(rows, 16, "Data", "Metabolites", F.concat(column_text("column", F.col("pos") + 1, F.col("dup")), F.lit(' has values that "'), "standard", F.lit('" should not have: '), "found"))


@check(20)
def several_standards(t: Shared) -> DataFrame:
    rows = t.standard.groupBy("file_id", "column", "dup", "pos").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("standard")), ", ").alias("found")).filter("n > 1")
    return issue(rows, 20, "Data", "Metabolites", F.concat(column_text("column", F.col("pos") + 1, F.col("dup")), F.lit(" could be several standard columns: "), "found"))


def _implied(t: Shared) -> DataFrame:
    """file_id, a, b (standard columns), column_a, pos_a, column_b and pos_b (null without one): pairs of which the first is there."""
    first = first_columns(t.standard)
    pairs = F.create_map(*(F.lit(x) for pair in IMPLIED.items() for x in pair))
    left = first.filter(F.col("standard").isin(*IMPLIED)).select("file_id", F.col("standard").alias("a"), pairs[F.col("standard")].alias("b"), F.col("column").alias("column_a"), F.col("pos").alias("pos_a"))
    return left.join(first.select("file_id", F.col("standard").alias("b"), F.col("column").alias("column_b"), F.col("pos").alias("pos_b")), ["file_id", "b"], "left")


@check(17)
def implied_columns(t: Shared) -> DataFrame:
    rows = _implied(t).filter("pos_b IS NULL")
    return issue(rows, 17, "Data", "Metabolites", F.concat(F.lit('The column "'), "column_a", F.lit('" needs a column "'), "b", F.lit('".')))


@check(18)
def paired_values(t: Shared) -> DataFrame:
    """Rows in which one of a pair of columns has a value and the other has none; a cell that is not there has none."""
    pairs = _implied(t).filter("pos_b IS NOT NULL")
    at = pairs.select("file_id", "a", "column_a", "column_b", F.explode(F.map_from_arrays(F.array("pos_a", "pos_b"), F.array(F.lit(True), F.lit(False)))).alias("pos", "first"))
    cells = cells_of(t, "Metabolites", at).withColumn("na", missing(F.col("value"), COLUMN_NA))
    side = lambda first: F.coalesce(F.bool_and(F.when(F.col("first") == first, F.col("na"))), F.lit(True))
    masks = cells.groupBy("file_id", "a", "column_a", "column_b", "row").agg(side(True).alias("x"), side(False).alias("y"))
    rows = rules.unlike_masks(masks, F.col("x"), F.col("y")).select("file_id", "column_a", "column_b").distinct()
    return issue(rows, 18, "Data", "Metabolites", F.concat(F.lit('Values of the columns "'), "column_a", F.lit('" and "'), "column_b", F.lit('" should stand in the same rows.')))


@check(19)
def other_id(t: Shared) -> DataFrame:
    rows = first_columns(t.standard).filter("standard = 'other_id'")
    return issue(rows, 19, "Data", "Metabolites", F.concat(F.lit('The column "'), "column", F.lit('" should be named after the database that its values are from.')))


def _has_table(t: Shared, table: str) -> DataFrame:
    return t.lists.filter(F.col(table).isNotNull()).select("file_id")


@check(21)
def extended_without_samples(t: Shared) -> DataFrame:
    rows = _has_table(t, "Extended").join(t.headers.filter("tbl = 'Extended' AND column = 'sample_id'"), "file_id", "left_anti")
    return issue(rows, 21, "Data", "Extended", 'The table has no column "sample_id".')


def _extended_samples(t: Shared) -> DataFrame:
    return cells_of(t, "Extended").filter("column = 'sample_id' AND dup = 0").select("file_id", F.col("value").alias("sample_id"))


@check(22)
def extended_samples(t: Shared) -> DataFrame:
    rows = rules.not_in(_extended_samples(t), t.ssf, ["file_id", "sample_id"])
    return issue(listed(rows, "sample_id"), 22, "Data", "Extended", F.concat(F.lit("Sample IDs without factors: "), "found"))


@check(23)
def header_like_names(t: Shared) -> DataFrame:
    out = None
    for table in ("Metabolites", "Data", "Extended"):
        rows = rules.header_like(names(t, table), "name", HEADER_LIKE)
        part = issue(rows, 23, "Data", table, F.concat(F.lit("The name in row "), F.col("row") + 1, F.lit(" looks like a header: "), "name"))
        out = part if out is None else out.unionByName(part)
    return out


@check(25)
def inconsistent_columns(t: Shared) -> DataFrame:
    """A row whose columns are not those of the first row (of JSON documents)."""
    rows = t.loose.join(t.files.filter("input_format = 'json'"), "file_id", "left_semi").groupBy("file_id", "tbl", "row").agg(
        F.sort_array(F.collect_list(F.struct("at", "column", "dup"))).alias("c")
    )
    rows = rows.select("file_id", "tbl", "row", F.transform("c", lambda x: F.struct(x["column"], x["dup"])).alias("c"))
    first = rows.groupBy("file_id", "tbl").agg(F.min_by("c", "row").alias("first"))
    rows = rows.join(first, ["file_id", "tbl"]).filter("c <> first").select("file_id", "tbl").distinct()
    return issue(rows, 25, "Data", F.col("tbl"), "Not all rows have the same columns in the same order.")


@check(26)
def nameless_columns(t: Tables) -> DataFrame:
    rows = t.headers.filter("column = ''").select("file_id", "tbl").distinct()
    return issue(rows, 26, "Data", F.col("tbl"), "A column has no name.")


def _columns(t: Shared, which: str) -> DataFrame:
    """file_id, tbl, column, dup and pos of the columns that are empty, or uniform."""
    by = ["file_id", "tbl", "column", "dup"]
    profile = rules.column_profile(t.loose.filter("column <> 'Metabolite'"), by, COLUMN_NA)
    found = (rules.null_columns(profile) if which == "empty" else rules.one_value_columns(profile)).select(*by)
    found = found.join(t.headers.groupBy(*by).agg(F.min("pos").alias("pos")), by)
    if t.digest is None:
        return found
    own = t.digest.select("file_id", "tbl", F.explode(F.filter("columns", lambda c: c[which])).alias("c")).select("file_id", "tbl", "c.column", "c.dup", F.col("c.pos").alias("pos"))
    return found.unionByName(own)


@check(27)
def null_columns(t: Shared) -> DataFrame:
    rows = _columns(t, "empty")
    return issue(rows, 27, "Data", F.col("tbl"), F.concat(column_text("column", F.col("pos") + 1, F.col("dup")), F.lit(" has no value.")))


@check(28)
def one_value_columns(t: Shared) -> DataFrame:
    rows = _columns(t, "uniform")
    return issue(rows, 28, "Data", F.col("tbl"), F.concat(column_text("column", F.col("pos") + 1, F.col("dup")), F.lit(" has nearly always the same value.")))


@check(29)
def equal_rows(t: Shared) -> DataFrame:
    rows = rules.equal_rows_of_cells(t.loose, ["file_id", "tbl"], "row", "pos", "value").select("file_id", "tbl").distinct()
    if t.digest is not None:
        rows = rows.unionByName(t.digest.filter("equal_rows").select("file_id", "tbl"))
    return issue(rows, 29, "Data", F.col("tbl"), "Some rows are equal.")


@check(30)
def repeated_columns(t: Tables) -> DataFrame:
    rows = t.headers.filter("tbl <> 'Data' AND dup > 0").select("file_id", "tbl", "column").distinct()
    return issue(rows, 30, "Data", F.col("tbl"), F.concat(F.lit("Several columns are named "), "column"))


@check(31)
def polarities(t: Shared) -> DataFrame:
    """The leftmost column of METABOLITES that the finder of polarities names and that holds both."""
    columns = t.standard.filter("standard = 'polarity'").select("file_id", "pos", F.col("column").alias("named"))
    cells = cells_of(t, "Metabolites", columns).select("file_id", "pos", F.lower("value").alias("value"), F.col("named").alias("column"))
    found = rules.both_values(cells, ["file_id", "pos", "column"], F.col("value").isin(*POSITIVE), F.col("value").isin(*NEGATIVE))
    rows = found.groupBy("file_id").agg(F.min_by("column", "pos").alias("column"))
    return issue(rows, 31, "Data", "Metabolites", F.concat(F.lit('Both polarities stand in the column "'), "column", F.lit('".')))


@check(32)
def no_method_section(t: Tables) -> DataFrame:
    has = t.items.filter("section IN ('MS', 'NM')").select("file_id").unionByName(t.results.select("file_id"))
    return issue(t.files.filter("error IS NULL").join(has, "file_id", "left_anti"), 32, "", "", "There is neither an MS nor an NM section.")


@check(33)
def no_metabolites(t: Shared) -> DataFrame:
    rows = t.files.filter("data_section IN ('MS_METABOLITE_DATA', 'NMR_METABOLITE_DATA')").join(_has_table(t, "Metabolites"), "file_id", "left_anti")
    return issue(rows, 33, F.col("data_section"), "Metabolites", "There is no METABOLITES section.")


@check(34)
def first_headers(t: Tables) -> DataFrame:
    heads = t.headers.filter("pos = 0").join(t.files.filter("input_format = 'text'").select("file_id", "data_section"), "file_id")
    binned = (F.col("data_section") == "NMR_BINNED_DATA") & (F.col("tbl") == "Data")
    want = F.when(binned, "Bin range(ppm)").when(F.col("tbl") == "Data", "Samples").otherwise("metabolite_name")
    rows = heads.withColumn("want", want).filter(F.lower("raw") != F.lower("want"))
    return issue(rows, 34, F.col("data_section"), F.col("tbl"), F.concat(F.lit("The header doesn't begin with "), "want"))


@check(35)
def blank_extended_samples(t: Shared) -> DataFrame:
    rows = rules.blank(_extended_samples(t), "sample_id", SCHEMA_NA).select("file_id").distinct()
    return issue(rows, 35, "Data", "Extended", "A row has no sample ID.")


@check(36)
def blank_in_extended(t: Shared) -> DataFrame:
    return issue(_with_blank(_named(t, "Extended")), 36, "Data", "Extended", "A metabolite has no name.")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Checks that are one plan where issues are stored.
STORED_TOGETHER = 6


def issues(
    t: Tables, numbers: tuple[int, ...] | None = None, extra: list[DataFrame] | None = None, finders: dict[str, Finder] | None = None, store: bool = False
) -> DataFrame:
    """All issues: ISSUE and ord, the place in a document's report. numbers: only these checks; extra: further issues; finders:
    the caller's own, in place of FINDERS; store: run a few checks at a time and write what they find to the shared
    folder, which keeps plans (and the driver's memory) small where all checks run."""
    t = shared(t, finders, numbers, store)
    parts = [CHECKS[n](t, finders) if n in BY_FINDERS else CHECKS[n](t) for n in ORDER if n in CHECKS and (numbers is None or n in numbers)] + (extra or [])
    if store:
        parts = [stored(_together(parts[i : i + STORED_TOGETHER]), "issues") for i in range(0, len(parts), STORED_TOGETHER)]
    out = _together([t.files.sparkSession.createDataFrame([], ISSUE), *parts])
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("id"))
    w = Window.partitionBy("file_id").orderBy(place, "section", "sub_section", "message")
    return out.withColumn("ord", F.row_number().over(w))


def reports(found: DataFrame) -> DataFrame:
    """file_id and text of each document with issues: a JSON array of them, in order, named as the document with _validations."""
    fields = ("id", "name", "severity", "tags", "section", "sub_section", "message")
    listed_issues = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("issue")))), lambda x: x["issue"])
    return found.groupBy("file_id").agg(F.to_json(listed_issues).alias("text")).select(F.concat("file_id", F.lit("_validations")).alias("file_id"), "text")


def summary(files: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, status, n_issues, n_warnings and the counts of tags for every readable document."""
    counts = found.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Warning").alias("w"))
    tags = rules.tag_counts(found, ["file_id"]).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("tag", "n"))).alias("tags"))
    out = files.filter("error IS NULL").select("file_id").join(counts, "file_id", "left").join(tags, "file_id", "left")
    status = F.when(F.col("n").isNull(), "Passing").otherwise("Contains Validation Issues")
    return out.select("file_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_issues"), F.coalesce("w", F.lit(0)).alias("n_warnings"), "tags")
