"""Tables back to documents, as text or as JSON; every document is one row, put together in the JVM."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import wrap
from assayspark.model import HEADER, MARKER, PREFIXES, TABLES, Tables

SSF = "SUBJECT_SAMPLE_FACTORS"
SSF_LINE = "#SUBJECT_SAMPLE_FACTORS:         \tSUBJECT(optional)[tab]SAMPLE[tab]FACTORS(NAME:VALUE pairs separated by |)[tab]Additional sample data"
#: Columns of the lines of all parts: where they stand in the document, then the text.
PLACE = ("s", "k", "r", "i")
WIDTH, KEY, SHORT_KEY, UNITS_KEY = 80, 30, 20, 33
LAST = len(PREFIXES) + 1
SECTION_ORDER = [s for s in PREFIXES if s != "METABOLITES"]


def _place(section: Column) -> Column:
    """Known sections in their order, others behind them."""
    at = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), section).cast("int")
    return F.when(at > 0, at).otherwise(LAST)


def _sorted(column: str, *order: str) -> Column:
    """The column's values of a group as an array in the given order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, column))), lambda x: x[column])


def _data_section(t: Tables, rows: DataFrame) -> DataFrame:
    """rows with the section that the document's tables stand in."""
    return rows.join(t.files.filter("data_section IS NOT NULL").select("file_id", F.col("data_section").alias("section")), "file_id")


def _results_key(section: Column) -> Column:
    return F.concat(F.when(section == "NM", "NMR").otherwise(section), F.lit("_RESULTS_FILE"))


def results_line(between: str) -> Column:
    """A row of results as one text, without what is null."""
    named = (("UNITS", "units"), ("Has m/z", "has_mz"), ("Has RT", "has_rt"), ("RT units", "rt_units"))
    return F.concat_ws(between, "filename", *(F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in named))


def text_lines(t: Tables) -> DataFrame:
    """file_id, the line's place (s, k, r, i) and line of all lines of text documents."""
    none = F.lit(0)

    def lines(rows: DataFrame, line: Column, s: Column, k: Column = none, r: Column = none, i: Column = none) -> DataFrame:
        return rows.select("file_id", *(c.cast("int").alias(n) for n, c in zip(PLACE, (s, k, r, i), strict=True)), line.alias("line"))

    section, key = F.col("section"), F.col("key")
    head = t.items.filter(section == HEADER)
    pairs = head.filter(~key.isin("VERSION", "CREATED_ON")).select("file_id", "ord", F.concat(key, F.lit(":"), "value").alias("word"))
    words = pairs.groupBy("file_id").agg(F.array_join(_sorted("word", "ord"), " ").alias("words"))
    heads = t.files.filter("error IS NULL").select("file_id").join(words, "file_id", "left")
    out = lines(heads, F.concat_ws(" ", F.lit(MARKER), "words"), F.lit(0))
    out = out.unionByName(lines(head.filter(key.isin("VERSION", "CREATED_ON")), F.concat(F.rpad(key, SHORT_KEY, " "), F.lit("\t"), "value"), F.lit(0), F.lit(1), F.col("ord")))

    body = t.items.filter((section != HEADER) & (key != "Units"))
    present = body.select("file_id", "section").unionByName(t.results.select("file_id", "section")).unionByName(t.items.filter("key = 'Units'").select("file_id", "section"))
    present = present.unionByName(_data_section(t, _with_cells(t)).select("file_id", "section")).distinct()
    out = out.unionByName(lines(present, F.concat(F.lit("#"), F.when(section == "NM", "NMR").otherwise(section)), _place(section)))
    padded = F.concat(_code(section), F.when(F.length(key) < KEY, F.rpad(key, KEY, " ")).otherwise(key), F.lit("\t"))
    long = (F.length("value") > WIDTH) & ~key.endswith("_FILENAME")
    wrapped = body.select("file_id", "section", "key", "ord", F.posexplode(F.when(long, wrap(F.col("value"), WIDTH)).otherwise(F.array("value"))).alias("i", "part"))
    out = out.unionByName(lines(wrapped.filter("part <> '' OR i = 0"), F.concat(padded, F.coalesce("part", F.lit(""))), _place(section), F.lit(1), F.col("ord"), F.col("i")))
    results = t.results.withColumn("key", _results_key(section))
    out = out.unionByName(lines(results, F.concat(padded, results_line("\t")), _place(section), F.lit(2)))

    samples = t.ssf.select(
        "file_id", "idx", F.concat(
            F.lit(SSF + 11 * " " + "\t"), F.coalesce("subject_id", F.lit("")), F.lit("\t"), F.coalesce("sample_id", F.lit("")), F.lit("\t"),
            _pairs("factors", ":", " | "), F.lit("\t"), _pairs("additional", "=", "; "),
        ).alias("line"),
    )
    at = F.lit(SECTION_ORDER.index(SSF) + 1)
    out = out.unionByName(lines(t.ssf.select("file_id").distinct(), F.lit(SSF_LINE), at)).unionByName(lines(samples, F.col("line"), at, F.lit(1), F.col("idx")))

    units = t.items.filter("key = 'Units'")
    unit_key = F.concat(section, F.lit(":UNITS"))
    out = out.unionByName(lines(units, F.concat(F.rpad(unit_key, UNITS_KEY, " "), F.lit("\t"), "value"), _place(section), F.lit(1)))
    tbl = F.col("tbl")
    k = 10 * F.array_position(F.array(*map(F.lit, TABLES)), tbl)
    tables = _data_section(t, t.blocks.select("file_id", "tbl").distinct())
    block = F.when(tbl == "Data", section).when(tbl == "Metabolites", "METABOLITES").otherwise(F.concat(F.lit("EXTENDED_"), section))
    out = out.unionByName(lines(tables.filter("tbl = 'Metabolites'"), F.lit("#METABOLITES"), _place(section), k))
    out = out.unionByName(lines(tables, F.concat(block, F.lit("_START")), _place(section), k + 1))
    out = out.unionByName(lines(tables, F.concat(block, F.lit("_END")), _place(section), k + 5))
    first = F.when((tbl == "Data") & (section == "NMR_BINNED_DATA"), "Bin range(ppm)").when(tbl == "Data", "Samples").otherwise("metabolite_name")
    names = t.headers.filter("named AND pos > 0").groupBy("file_id", "tbl").agg(_sorted("column", "pos").alias("names"))
    names = tables.join(names, ["file_id", "tbl"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    out = out.unionByName(lines(names, F.array_join(F.concat(F.array(first), "names"), "\t"), _place(section), k + 2))
    out = out.unionByName(lines(_factor_lines(t, names.filter("tbl = 'Data' AND section <> 'NMR_BINNED_DATA'")), F.col("line"), _place(section), F.lit(13)))
    rows = filled(t if t.lists is None else replace(t, cells=t.loose)).select("file_id", "tbl", "row", F.array_join("values", "\t").alias("line"))
    if t.lists is not None:  # and tables that are known as a whole
        whole = _listed(t.lists) if t.grids is None else _listed(t.lists).unionByName(_gridded(t.grids))
        rows = rows.unionByName(whole.select("file_id", "tbl", F.lit(0).alias("row"), "line"))
    out = out.unionByName(lines(_data_section(t, rows), F.col("line"), _place(section), k + 4, F.col("row")))
    return out.unionByName(lines(heads, F.lit("#END"), F.lit(LAST + 1)))


def _code(section: Column) -> Column:
    """The two-letter code and colon that a section's item lines begin with."""
    out = F.lit("")
    for name, prefix in PREFIXES.items():
        out = F.when(section == name, prefix).otherwise(out) if prefix else out
    return out


def _pairs(column: str, sign: str, bar: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat(x["key"], F.lit(sign), F.coalesce(x["value"], F.lit("")))), bar)


def _factor_lines(t: Tables, names: DataFrame) -> DataFrame:
    """The Factors line of data tables: from the table where it had one, else from the samples. A document of which any
    sample lacks factors has no such line."""
    own = t.factors.select("file_id", "sample_id", "ord", F.concat("key", F.lit(":"), "value").alias("pair")).groupBy("file_id", "sample_id").agg(F.array_join(_sorted("pair", "ord"), " | ").alias("own"))
    last = t.ssf.groupBy("file_id", "sample_id").agg(F.max_by(_pairs("factors", ":", " | "), "idx").alias("given"))
    has_own = t.factors.select("file_id").distinct().withColumn("has_own", F.lit(True))
    each = names.select("file_id", "section", F.posexplode("names").alias("pos", "sample_id")).join(has_own, "file_id", "left")
    each = each.join(own, ["file_id", "sample_id"], "left").join(last, ["file_id", "sample_id"], "left")
    each = each.withColumn("text", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("given")))
    whole = each.groupBy("file_id", "section").agg(F.bool_and(F.col("text").isNotNull()).alias("whole"), _sorted("text", "pos").alias("texts"))
    return whole.filter("whole").select("file_id", "section", F.array_join(F.concat(F.array(F.lit("Factors")), "texts"), "\t").alias("line"))


def filled(t: Tables) -> DataFrame:
    """file_id, tbl, row and values: a row's cells in the order of the table's columns, an empty one for each column that it lacks. What a row lacks is
    filled in within the row."""
    width = t.headers.groupBy("file_id", "tbl").agg((F.max("pos") + 1).alias("width"))
    rows = t.cells.groupBy("file_id", "tbl", "row").agg(F.collect_list(F.struct("pos", "value")).alias("cells")).join(width, ["file_id", "tbl"], "left")
    lacks = F.array_except(F.sequence(F.lit(0), F.col("width") - 1), F.transform("cells", lambda x: x["pos"]))
    whole = F.concat("cells", F.transform(lacks, lambda i: F.struct(i.alias("pos"), F.lit("").alias("value"))))
    whole = F.sort_array(F.when(F.size("cells") < F.col("width"), whole).otherwise(F.col("cells")))
    return rows.select("file_id", "tbl", "row", F.transform(whole, lambda x: F.coalesce(x["value"], F.lit(""))).alias("values"))


def _with_cells(t: Tables) -> DataFrame:
    """The file_id of documents whose tables have cells."""
    if t.lists is None:
        return t.cells.select("file_id")
    found = t.lists.select("file_id").unionByName(t.loose.select("file_id"))
    return found if t.grids is None else found.unionByName(t.grids.filter(F.size("values") > 0).select("file_id"))


def _gridded(grids: DataFrame) -> DataFrame:
    """file_id, tbl and line: the lines of all rows of a table."""
    return grids.filter(F.size("values") > 0).select("file_id", "tbl", F.array_join(F.transform("values", lambda x: F.array_join(x, "\t")), "\n").alias("line"))


def _listed(lists: DataFrame) -> DataFrame:
    """As _gridded(), of rows that lack columns or have them in another order: tabs stand for what they lack."""
    tabs = lambda n: F.repeat(F.lit("\t"), n)

    def add(held: Column, x: Column) -> Column:
        before = F.when(held["any"], F.greatest(x["pos"] - held["pos"], F.lit(1))).otherwise(x["pos"])
        return F.struct(F.lit(True).alias("any"), x["pos"].alias("pos"), F.concat(held["line"], tabs(before), F.coalesce(x["value"], F.lit(""))).alias("line"))

    start = F.struct(F.lit(False).alias("any"), F.lit(0).alias("pos"), F.lit("").alias("line"))
    line = lambda x: F.aggregate(F.sort_array(x["cells"]), start, add, lambda held: F.concat(held["line"], tabs(F.size("names") - 1 - held["pos"])))
    return lists.select("file_id", "tbl", F.array_join(F.transform(F.filter("rows", lambda x: F.size(x["cells"]) > 0), line), "\n").alias("line"))


def to_text(t: Tables) -> DataFrame:
    """file_id and text of every readable document, in the text form."""
    lines = text_lines(t).groupBy("file_id").agg(_sorted("line", *PLACE).alias("lines"))
    return lines.select("file_id", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def _written(value: str = "value") -> Column:
    """An item's or cell's value as it stood in JSON: text that is no string as it is."""
    return F.when(F.col("raw"), F.col(value)).otherwise(_quoted(F.col(value)))


def _quoted(value: Column) -> Column:
    """The value as a JSON string, or null as null."""
    held = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(held, r"(?s)^\[(.*)\]$", 1))


def _braced(parts: Column, depth: int, marks: str = "{}") -> Column:
    """The parts, one a line, between marks, for an object or array that stands so deep."""
    inner, outer = "    " * (depth + 1), "    " * depth
    held = F.concat(F.lit(f"{marks[0]}\n{inner}"), F.array_join(parts, f",\n{inner}"), F.lit(f"\n{outer}{marks[1]}"))
    return F.when(F.size(parts) == 0, marks).otherwise(held)


def _member(key: Column | str, value: Column) -> Column:
    return F.concat(_quoted(F.lit(key) if isinstance(key, str) else key), F.lit(": "), value)


def to_json(t: Tables) -> DataFrame:
    """file_id and text of every readable document, as JSON; keys that repeat are written again."""
    section, tbl = F.col("section"), F.col("tbl")
    binned = (section == "NMR_BINNED_DATA") & (tbl == "Data") & (F.col("column") == "Metabolite")
    cells = _data_section(t, t.cells).withColumn("part", _member(F.when(binned, "Bin range(ppm)").otherwise(F.col("column")), _written()))
    cells = cells.withColumn("behind", (F.col("column") != "Metabolite").cast("int"))  # the name comes first
    rows = cells.groupBy("file_id", "section", "tbl", "row").agg(_braced(_sorted("part", "behind", "at"), 3).alias("part"))
    tables = rows.groupBy("file_id", "section", "tbl").agg(_braced(_sorted("part", "row"), 2, "[]").alias("rows"))
    at = F.array_position(F.array(*map(F.lit, TABLES)), tbl).cast("int")
    parts = tables.select("file_id", "section", (at - 10).alias("ord"), _member(tbl, F.col("rows")).alias("part"))
    item_at = F.when(F.col("key") == "Units", -100).otherwise(F.col("ord")).cast("int")
    parts = parts.unionByName(t.items.select("file_id", "section", item_at.alias("ord"), _member(F.col("key"), _written()).alias("part")))
    results = t.results.select("file_id", "section", F.lit(1_000_000).alias("ord"), _member(_results_key(section), _quoted(results_line(" "))).alias("part"))
    whole = parts.unionByName(results).groupBy("file_id", "section").agg(_member(section, _braced(_sorted("part", "ord"), 1)).alias("part"))

    pairs = lambda c: _braced(F.transform(c, lambda x: _member(x["key"], _quoted(x["value"]))), 3)
    member = F.array_compact(
        F.array(
            _member("Subject ID", _quoted(F.col("subject_id"))), _member("Sample ID", _quoted(F.col("sample_id"))), _member("Factors", pairs("factors")),
            F.when(F.size("additional") > 0, _member("Additional sample data", pairs("additional"))),
        )
    )
    samples = t.ssf.select("file_id", "idx", _braced(member, 2).alias("part")).groupBy("file_id").agg(_braced(_sorted("part", "idx"), 1, "[]").alias("part"))
    whole = whole.unionByName(samples.select("file_id", F.lit(SSF).alias("section"), _member(SSF, F.col("part")).alias("part")))
    whole = whole.join(t.files.filter("error IS NULL"), "file_id", "left_semi").withColumn("at", _place(section))
    return whole.groupBy("file_id").agg(_braced(_sorted("part", "at", "section"), 0).alias("text"))


def output_name(file_id: Column, folder: str, extension: str) -> Column:
    """A document's path below the folder, with the extension behind it if it doesn't end so."""
    name = F.when(file_id.startswith(folder), F.substring(file_id, F.lit(len(folder) + 1), F.length(file_id))).otherwise(file_id)
    name = F.regexp_replace(name, "^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "")
    name = F.array_join(F.filter(F.split(name, "/"), lambda x: ~x.isin("", ".", "..")), "/")
    return F.when(name.endswith(f".{extension}"), name).otherwise(F.concat(name, F.lit(f".{extension}")))
