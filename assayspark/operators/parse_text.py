"""Text documents to tables: lines, the section and block that each line stands in, and projections of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from assayspark.functions.columns import results_file
from assayspark.model import DATA_SECTIONS, HEADER, MARKER, Tables, stored


def along() -> WindowSpec:
    """A document's lines in order."""
    return Window.partitionBy("file_id").orderBy("line_no")


def is_text(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"^[\r\n]*{MARKER}"))


def lines(documents: DataFrame) -> DataFrame:
    """file_id, line_no and line of all lines that are not empty; carriage returns end lines too."""
    rows = documents.select("file_id", F.posexplode(F.split(F.regexp_replace("text", "\r", "\n"), "\n")).alias("line_no", "line"))
    return rows.filter("line <> ''")


def numbered(pairs: Column) -> Column:
    """An array of key and value with the number of equal keys before each; for the few pairs of a sample (a table's columns are
    numbered by a window)."""
    before = lambda i, x: F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.transform(pairs, lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), before(i, x).alias("dup")))


def _last(text: Column, bar: str) -> tuple[Column, Column]:
    """What stands before and after the last bar; without one, the text and null."""
    pattern = rf"(?s)^(.*){bar}(.*)$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2))


def pairs(text: Column, sign: str, bar: str) -> Column:
    """`key<sign>value<bar>key<sign>value` as an array of key and value, both stripped."""
    parts = F.split(text, sign)
    n = F.size(parts)
    made = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(
            F.trim(F.when(i == 1, F.get(parts, F.lit(0))).otherwise(_last(F.get(parts, i - 1), bar)[1])).alias("key"),
            F.trim(_last(F.get(parts, i), bar)[0]).alias("value"),
        ),
    )
    return F.when(n > 1, made).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def bad_pair(text: Column, sign: str, bar: str) -> Column:
    """The first part between two signs that has no bar, or null."""
    parts = F.split(text, sign)
    return F.get(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: ~x.rlike(bar)), F.lit(0))


def _rest(array: str) -> Column:
    """All elements but the first."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1)))


def _tokens(line: Column) -> Column:
    """The cells of a line, without quotes and spaces around them and without empty ones at its end."""
    none = F.array().cast("array<string>")
    trimmed = _held(F.rtrim(line, F.lit('" \t')), lambda used: F.when(used == "", none).otherwise(F.transform(F.split(used, "\t"), lambda x: F.btrim(x, F.lit('" ')))))
    plain = _held(F.rtrim(line, F.lit("\t")), lambda used: F.when(used == "", none).otherwise(F.split(used, "\t")))
    return F.when(line.contains('"') | line.contains(" "), trimmed).when(line.endswith("\t"), plain).otherwise(F.split(line, "\t"))


def _is_header(tokens: Column, block_name: Column, samples: Column) -> Column:
    """Whether one of the first two lines of a block is a header."""
    first = F.get(tokens, F.lit(0))
    known = F.arrays_overlap(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), samples)
    named = first.isin("Samples", "metabolite name", "metabolite_name") & ((F.size(tokens) == 1) | (F.size(samples) == 0))
    extended, binned, measured = block_name.contains("EXTENDED"), block_name.contains("BINNED_DATA"), block_name.contains("METABOLITE_DATA")
    is_header = (
        F.when(binned & ~extended, first == "Bin range(ppm)")
        .when((first == "Factors") & measured, F.lit(True))
        .when(measured & ~extended, known | named)
        .otherwise(F.lower(first) == "metabolite_name")
    )
    return F.coalesce(is_header, F.lit(False))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once, however often it is used, in lambdas too."""
    return F.transform(F.array(value), use)[0]


def _repeats(names: Column) -> Column:
    """The number of equal names before each, of an array; only names that repeat are looked for."""

    def numbers(names: Column, again: Column) -> Column:
        before = lambda x, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
        return F.transform(names, lambda x, i: F.when(F.array_contains(again, x), before(x, i)).otherwise(0))

    again = lambda ordered: F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1))
    some = lambda names: _held(F.sort_array(names), lambda ordered: _held(again(ordered), lambda x: numbers(names, x)))
    return _held(names, lambda names: F.when(F.size(F.array_distinct(names)) == F.size(names), F.transform(names, lambda x: F.lit(0))).otherwise(some(names)))


REGION = "array<struct<at:int,starts:boolean,section:string,block_name:string>>"


def located(documents: DataFrame) -> DataFrame:
    """A row for each document: file_id, data_section, outside (at, section, kind and line of the lines beside tables) and tables (section, tbl, at,
    first: its two first lines with is_header, names, body: the rows' cells; and of all blocks of that table in the document: heads, dups, width,
    whether it is the leading one, and the rows before it).

    A document's lines are found and read within its row, so nothing is shuffled: a few lines mark where sections and blocks begin and
    end, and all between two marks is alike."""
    line_of = F.split(F.replace("text", F.lit("\r"), F.lit("\n")), "\n")
    rows = documents.select("file_id", F.filter(line_of, lambda x: x != "").alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda m: m["line"].startswith("#") | m["line"].endswith("_START") | m["line"].endswith("_END"))

    def add(held: Column, mark: Column) -> Column:
        line = mark["line"]
        starts = line.endswith("_START")
        edge = starts | line.endswith("_END")
        block_name = F.when(starts, F.substring(line, F.lit(1), F.length(line) - 6)).when(edge, "").otherwise(held["block_name"])
        name = F.when(line.startswith(MARKER), HEADER).when(line.startswith("#SUBJECT_SAMPLE_FACTORS:"), "SUBJECT_SAMPLE_FACTORS").otherwise(F.trim(F.substring(line, F.lit(2), F.length(line))))
        section = F.when(line.startswith("#"), F.when(name == "NMR", "NM").otherwise(name)).otherwise(held["section"])
        region = F.struct(mark["at"].alias("at"), starts.alias("starts"), section.alias("section"), block_name.alias("block_name"))
        new = F.struct(block_name.alias("block_name"), section.alias("section"), F.array_append(held["out"], region).alias("out"))
        return F.when((held["block_name"] != "") & ~edge, held).otherwise(new)  # a row of a table may begin with #

    start = F.struct(F.lit("").alias("block_name"), F.lit(None).cast("string").alias("section"), F.array().cast(REGION).alias("out"))
    rows = rows.select("file_id", "lines", F.aggregate(marks, start, add, lambda held: held["out"]).alias("r"))
    held = lambda r, i: F.slice("lines", r["at"] + 1, F.coalesce(F.get("r", i + 1)["at"], F.size("lines")) - r["at"])
    region = F.transform(
        "r", lambda r, i: F.struct(r["at"].alias("at"), (r["starts"] & (r["block_name"] != "")).alias("table"), r["section"].alias("section"), r["block_name"].alias("block_name"), held(r, i).alias("lines"))
    )
    rows = rows.select("file_id", region.alias("r"), F.get(F.filter("r", lambda r: r["section"].isin(*DATA_SECTIONS)), F.lit(0))["section"].alias("data_section"))
    # METABOLITES belong to the document's data section
    rows = rows.withColumn("r", F.filter("r", lambda r: r["section"].isNotNull() & ((r["section"] != "METABOLITES") | F.col("data_section").isNotNull())))
    section = lambda r: F.when(r["section"] == "METABOLITES", F.col("data_section")).otherwise(r["section"])

    def kind(line: Column) -> Column:
        return (
            F.when(line.startswith(MARKER), "header")
            .when(line.startswith("#"), "section")
            .when(line.startswith("SUBJECT_SAMPLE_FACTORS"), "ssf")
            .when(line.endswith("_START") | line.endswith("_END"), "edge")
            .when(line.contains("_RESULTS_FILE"), "results")
            .otherwise("item")
        )

    beside = lambda r: F.slice(r["lines"], F.lit(1), F.when(r["table"], 1).otherwise(F.size(r["lines"])))
    outside = F.flatten(F.transform("r", lambda r: F.transform(beside(r), lambda x, i: F.struct((r["at"] + i).alias("at"), section(r).alias("section"), kind(x).alias("kind"), x.alias("line")))))
    rows = rows.withColumn("outside", F.filter(outside, lambda x: ~x["kind"].isin("section", "edge")))
    sample = F.transform(F.filter("outside", lambda x: x["kind"] == "ssf"), lambda x: F.get(F.split(x["line"], "\t"), F.lit(2)))
    rows = rows.withColumn("samples", F.array_distinct(F.array_compact(sample)))  # a document's own

    # tables
    tbl = lambda r: F.when(r["block_name"] == "METABOLITES", "Metabolites").when(r["block_name"].startswith("EXTENDED_"), "Extended").otherwise("Data")
    table = F.transform(
        F.filter("r", lambda r: r["table"] & (F.size(r["lines"]) > 1)),
        lambda r: F.struct(section(r).alias("section"), tbl(r).alias("tbl"), r["at"].alias("at"), r["block_name"].alias("block_name"), F.transform(F.slice(r["lines"], F.lit(2), F.size(r["lines"])), _tokens).alias("rows")),
    )
    rows = rows.select("file_id", "data_section", "outside", "samples", table.alias("t"))
    first = lambda t: F.transform(F.slice(t["rows"], 1, 2), lambda x: F.struct(x.alias("tokens"), _is_header(x, t["block_name"], F.col("samples")).alias("is_header")))
    table = F.transform("t", lambda t: F.struct(t["section"].alias("section"), t["tbl"].alias("tbl"), t["at"].alias("at"), first(t).alias("first"), t["rows"].alias("rows")))
    rows = rows.select("file_id", "data_section", "outside", table.alias("t"))
    top = lambda t: F.get(t["rows"], F.lit(0))
    names = lambda t: F.concat(F.array(F.lit("Metabolite")), F.slice(top(t), F.lit(2), F.greatest(F.size(top(t)), F.lit(1))))
    body = lambda t: F.concat(F.transform(F.filter(t["first"], lambda x: ~x["is_header"]), lambda x: x["tokens"]), F.slice(t["rows"], F.lit(3), F.size(t["rows"])))
    table = F.transform("t", lambda t: F.struct(t["section"].alias("section"), t["tbl"].alias("tbl"), t["at"].alias("at"), t["first"].alias("first"), names(t).alias("names"), body(t).alias("body")))
    rows = rows.select("file_id", "data_section", "outside", table.alias("t"))
    table = F.transform(
        "t",
        lambda t: F.struct(
            t["section"].alias("section"), t["tbl"].alias("tbl"), t["at"].alias("at"), t["first"].alias("first"), t["names"].alias("names"), t["body"].alias("body"),
            F.transform(t["names"], lambda x, i: F.struct(x.alias("column"), F.get(t["first"][0]["tokens"], i).alias("raw"))).alias("heads"),
            F.when(F.size(t["body"]) > 0, F.greatest(F.size(t["names"]), F.array_max(F.transform(t["body"], F.size)))).otherwise(0).alias("width"),
        ),
    )
    rows = rows.select("file_id", "data_section", "outside", table.alias("t"))
    # of several blocks of a table, columns stand at the same places, and rows go on
    peers = lambda t: F.filter("t", lambda x: x["tbl"] == t["tbl"])
    most = lambda xs: F.array_max(F.transform(xs, lambda x: F.size(x["heads"])))
    merged = lambda xs: F.transform(F.sequence(F.lit(0), most(xs) - 1), lambda i: F.array_min(F.transform(xs, lambda x: F.get(x["heads"], i))))
    before = lambda t: F.aggregate(F.filter(peers(t), lambda x: x["at"] < t["at"]), F.lit(0), lambda n, x: n + F.size(x["body"]))
    heads = lambda t: F.when(F.size(peers(t)) == 1, t["heads"]).otherwise(merged(peers(t)))
    table = F.transform(
        "t",
        lambda t: F.struct(
            t["section"].alias("section"), t["tbl"].alias("tbl"), t["at"].alias("at"), t["first"].alias("first"), t["names"].alias("names"), t["body"].alias("body"), heads(t).alias("heads"),
            F.array_max(F.transform(peers(t), lambda x: x["width"])).alias("width"), (F.get(peers(t), F.lit(0))["at"] == t["at"]).alias("leads"), before(t).alias("before"),
        ),
    )
    rows = rows.select("file_id", "data_section", "outside", table.alias("t"))
    table = F.transform("t", lambda t: t.withField("dups", _repeats(F.transform(t["heads"], lambda x: x["column"]))))
    return rows.select("file_id", "data_section", "outside", table.alias("tables"))


def _rows_of(block: DataFrame) -> DataFrame:
    """file_id, tbl, row, names, dups and values: the rows of located() tables, as long as the names at least."""
    body = block.select("file_id", "tbl", "before", "names", "dups", F.posexplode("body").alias("i", "tokens"))
    lacks = F.greatest(F.size("names") - F.size("tokens"), F.lit(0))
    values = F.when(lacks > 0, F.concat("tokens", F.array_repeat(F.lit(""), lacks))).otherwise(F.col("tokens"))
    return body.select("file_id", "tbl", (F.col("before") + F.col("i")).alias("row"), "names", "dups", values.alias("values"))


def _cells_of(block: DataFrame) -> DataFrame:
    """The cells of located() tables, as in Tables."""
    cells = _rows_of(block).select("file_id", "tbl", "row", "names", "dups", F.posexplode("values").alias("pos", "value"))
    # the number of equal names before a column follows from the header alone; cells beyond it have the empty name
    dup = F.coalesce(F.get("dups", F.col("pos")), F.col("pos") - F.size("dups"))
    return cells.select("file_id", "tbl", "row", "pos", F.col("pos").alias("at"), F.coalesce(F.get("names", F.col("pos")), F.lit("")).alias("column"), dup.alias("dup"), "value", F.lit(False).alias("raw"))


def text_values(documents: DataFrame) -> DataFrame:
    """file_id, tbl, row, metabolite, column, dup and value: the cells of documents(file_id, text, error) that are not empty, each beside the
    metabolite of its row, which is looked up within the row. Those that are not text are left out. Tables are written to the shared folder first."""
    documents = documents.filter(F.col("error").isNull() & is_text(F.col("text")))
    rows = _rows_of(stored(located(documents), "located").select("file_id", F.inline("tables")))
    cell = lambda x, i: F.struct(F.coalesce(F.get("names", i), F.lit("")).alias("column"), F.coalesce(F.get("dups", i), i - F.size("dups")).alias("dup"), x.alias("value"))
    rows = rows.select("file_id", "tbl", "row", F.filter(F.transform("values", cell), lambda x: (x["value"] != "") | (x["column"] == "Metabolite")).alias("cells"))
    is_name = lambda x: (x["column"] == "Metabolite") & (x["dup"] == 0)
    names = F.transform(F.filter("cells", is_name), lambda x: x["value"])
    rows = rows.select("file_id", "tbl", "row", F.explode(names).alias("metabolite"), F.filter("cells", lambda x: ~is_name(x) & (x["value"] != "")).alias("cells"))
    return rows.select("file_id", "tbl", "row", "metabolite", F.inline("cells"))


def text_cells(documents: DataFrame) -> DataFrame:
    """The cells of documents(file_id, text, error), as in Tables, for callers that read nothing else; nothing is written. Those that are not text are left out."""
    documents = documents.filter(F.col("error").isNull() & is_text(F.col("text")))
    # not inline(), for which Spark would look for documents without tables first, and read each twice
    return _cells_of(located(documents).select("file_id", F.inline_outer("tables")).filter("tbl IS NOT NULL"))


def text_tables(documents: DataFrame, store_tables: bool = True) -> Tables:
    """All tables of documents(file_id, text, error); those that are not text are left out. Documents are located() once, which is written to
    the shared folder; cells follow from it without a shuffle. store_tables=False: only the lines beside tables are written, for callers who read few tables."""
    documents = documents.filter(F.col("error").isNull() & is_text(F.col("text")))
    found = stored(located(documents) if store_tables else located(documents).drop("tables"), "located")
    rows = found.select("file_id", "data_section", F.inline("outside")).withColumnRenamed("at", "line_no")
    line, key_part = F.col("line"), F.split("line", "\t", 2)[0]

    # items
    words = rows.filter("kind = 'header'").select("file_id", "section", "line_no", F.posexplode(F.split("line", "[ \t]")).alias("at", "word")).filter("word LIKE '%:%'")
    words = words.select("file_id", "section", "line_no", "at", F.split("word", ":")[0].alias("key"), F.split("word", ":")[1].alias("value"), (F.size(F.split("word", ":")) > 2).alias("bad"))
    item = rows.filter("kind = 'item'").withColumns({"k": key_part, "v": F.get(F.split("line", "\t", 2), F.lit(1))})
    coded = F.col("k").contains(":")
    key = F.when(coded & F.col("k").contains(":UNITS"), "Units").when(coded, F.expr("substring(trim(k), 4)")).otherwise(F.trim("k"))
    item = item.select("file_id", "section", "line_no", F.lit(0).alias("at"), key.alias("key"), F.when(coded, F.col("v")).otherwise(F.trim("v")).alias("value"), F.col("v").isNull().alias("bad"))
    every = words.unionByName(item)
    lines_of = rows.filter("kind IN ('header', 'item')").select("file_id", "line_no", F.col("line").alias("text"))
    values = F.sort_array(F.collect_list(F.struct("line_no", "at", "value")))
    joined = every.filter("NOT bad").groupBy("file_id", "section", "key").agg(values.alias("held"), F.min(F.struct("line_no", "at")).alias("first"))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("repeated"))
    header = F.col("section") == HEADER

    def add(held: Column, new: Column) -> Column:
        again = F.coalesce(held["value"] == new["value"], F.lit(False))
        value = F.when(held["value"].isNull() | header, new["value"]).otherwise(F.concat_ws(" ", held["value"], new["value"]))
        return F.struct(value.alias("value"), (held["repeated"] | again).alias("repeated"))

    place = Window.partitionBy("file_id", "section").orderBy("first")
    items = joined.select("file_id", "section", (F.row_number().over(place) - 1).alias("ord"), "key", F.aggregate("held", start, add).alias("x"))
    items = items.select("file_id", "section", "ord", "key", "x.value", "x.repeated", F.lit(False).alias("raw"))

    # samples
    part = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    ssf = rows.filter("kind = 'ssf'").select(
        "file_id", (F.row_number().over(along()) - 1).alias("idx"), part(1).alias("subject_id"), part(2).alias("sample_id"), part(3).alias("f"), F.coalesce(part(4), F.lit("")).alias("a")
    )
    bad_ssf = ssf.select("file_id", F.coalesce(F.when(F.col("f").isNull(), "list index out of range"), bad_pair(F.col("f"), ":", r"\| "), bad_pair(F.col("a"), "=", "; ")).alias("bad"))
    ssf = ssf.select("file_id", "idx", "subject_id", "sample_id", numbered(pairs(F.col("f"), ":", r"\| ")).alias("factors"), numbered(pairs(F.col("a"), "=", "; ")).alias("additional"))

    # tables
    found_tables = found if store_tables else located(documents)
    block = found_tables.select("file_id", F.inline("tables"))
    cells = _cells_of(block)
    width = F.array_max(F.transform("body", F.size))
    alone = lambda t: F.size(F.filter("tables", lambda x: x["tbl"] == t["tbl"])) == 1
    each = found_tables.select("file_id", F.inline(F.transform("tables", lambda t: t.withField("alone", alone(t)))))
    is_grid = F.col("alone") & F.coalesce(width <= F.size("names"), F.lit(False))
    filled = lambda x: F.concat(x, F.array_repeat(F.lit(""), F.size("names") - F.size(x)))
    grids = each.filter(is_grid).select("file_id", "tbl", "names", "dups", F.transform("body", lambda x: F.when(F.size(x) == F.size("names"), x).otherwise(filled(x))).alias("values"))
    others = _cells_of(each.filter(~is_grid))
    head = block.filter("leads").select("file_id", "tbl", "heads", "dups", "width")
    named = F.transform("heads", lambda x, i: F.struct(i.alias("pos"), x["raw"].alias("raw"), x["column"].alias("column"), F.get("dups", i).alias("dup"), F.lit(True).alias("named")))
    n = F.size("heads")
    beyond = F.transform(F.sequence(n, F.col("width") - 1), lambda i: F.struct(i.alias("pos"), F.lit("").alias("raw"), F.lit("").alias("column"), (i - n).alias("dup"), F.lit(False).alias("named")))
    headers = head.select("file_id", "tbl", F.inline(F.when(F.col("width") > n, F.concat(named, beyond)).otherwise(named)))
    over = F.exists("body", lambda x: F.size(x) > F.size("names"))
    blocks = block.select("file_id", "section", "tbl", over.alias("overflow")).groupBy("file_id", "section", "tbl").agg(F.bool_or("overflow").alias("overflow"))
    top = block.select("file_id", F.col("first")[0]["tokens"].alias("header"), F.explode("first").alias("x"))
    of_sample = top.filter(F.col("x.is_header") & (F.get("x.tokens", F.lit(0)) == "Factors")).select("file_id", "header", "x.tokens")
    of_sample = of_sample.select("file_id", F.posexplode(F.arrays_zip(_rest("header").alias("s"), _rest("tokens").alias("f"))).alias("i", "z"))
    pair = of_sample.select("file_id", F.col("z.s").alias("sample_id"), F.posexplode(F.split("z.f", r"\| ")).alias("ord", "p"))
    factors = pair.select("file_id", "sample_id", "ord", F.trim(F.split("p", ":")[0]).alias("key"), F.trim(F.get(F.split("p", ":"), F.lit(1))).alias("value"))

    # results files
    to = F.when(~F.col("section").isin(*DATA_SECTIONS), F.col("section")).when(F.col("data_section").startswith("MS"), "MS").otherwise("NM")
    results = rows.filter("kind = 'results'").select("file_id", to.alias("section"), results_file(F.get(F.split("line", "\t", 2), F.lit(1))).alias("r")).select("file_id", "section", "r.*")

    faults = every.filter("bad").join(lines_of, ["file_id", "line_no"]).select("file_id", F.concat(F.lit("No tab, or not one value, in: "), "text").alias("bad"))
    faults = faults.unionByName(bad_ssf.filter("bad IS NOT NULL").select("file_id", F.concat(F.lit("A separator is missing or doubled near: "), "bad").alias("bad")))
    faults = faults.groupBy("file_id").agg(F.min("bad").alias("error"))
    files = found.select("file_id", F.lit("text").alias("input_format"), "data_section").join(faults, "file_id", "left")
    files = files.select("file_id", "input_format", "data_section", "error")
    return Tables(files, items, ssf, headers, cells, factors, blocks, results).with_grids(grids, others)
