"""The operators as queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import compression, full_id, id_kind, is_numeric, is_url, positive, results_file, url_part, wrap
from assayspark.functions.finders import Finder
from assayspark.functions.na import COLUMN_NA, METABOLITE_NA, SCHEMA_NA
from assayspark.operators import rules, schema
from assayspark.operators.extract import ItemIs, ItemLike, metabolite_counts, metabolite_samples
from assayspark.operators.parse_text import lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


@query(
    "q01_extract_counts",
    """
    WITH m AS (
      SELECT l.l_partkey AS metabolite, c.c_nationkey AS study, l.l_orderkey AS analysis, l.l_suppkey AS sample
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
      WHERE TRY_CAST(CAST(l.l_discount AS VARCHAR) AS DOUBLE) > 0
    )
    SELECT metabolite, count(DISTINCT study) AS num_studies, count(DISTINCT (study, analysis)) AS num_analyses,
           count(DISTINCT (study, analysis, sample)) AS num_samples
    FROM m GROUP BY metabolite
    """,
)
def extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts studies, analyses and samples with a positive measurement, for each metabolite (here: part)."""
    counts = metabolite_counts(_measured(spark, sf_dir), most=table(spark, sf_dir, "lineitem").count())
    return counts.withColumnsRenamed({"metabolite_name": "metabolite", "num-studies": "num_studies"})


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive values: parts are metabolites, nations studies, orders analyses and suppliers samples."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = line.filter(positive(F.col("l_discount").cast("string"))).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    names = {"l_partkey": "metabolite", "c_nationkey": "study_id", "l_orderkey": "analysis_id", "l_suppkey": "sample_id"}
    return rows.select(*(F.col(c).alias(n) for c, n in names.items()))


#: The driver's dimension tables as (key, value) items.
ITEMS = (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"))


@query(
    "q02_extract_nested",
    """
    SELECT l.l_partkey AS metabolite, c.c_nationkey AS study,
           array_to_string(list_sort(list(DISTINCT CAST(l.l_suppkey AS VARCHAR))), ',') AS samples
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE TRY_CAST(CAST(l.l_discount AS VARCHAR) AS DOUBLE) > 0 GROUP BY 1, 2
    """,
)
def extract_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with a positive measurement, by metabolite and study, as sorted sets."""
    rows = _measured(spark, sf_dir).select("metabolite", "study_id", F.lit(None).alias("analysis_id"), F.col("sample_id").cast("string").alias("sample_id"))
    return metabolite_samples(rows).select("metabolite", F.col("study_id").alias("study"), F.array_join("samples", ",").alias("samples"))


@query(
    "q03_metadata_values",
    "SELECT key, array_to_string(list_sort(list(DISTINCT value)), '|') AS values_found, count(DISTINCT value) AS n_values FROM ("
    + " UNION ALL ".join(f"SELECT '{c.upper()}' AS key, {c} AS value FROM {t}" for t, c in ITEMS)
    + ") GROUP BY key",
)
def metadata_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of each metadata key, over all tables, as one sorted set."""
    parts = [table(spark, sf_dir, t).select(F.lit(c.upper()).alias("key"), F.col(c).alias("value")) for t, c in ITEMS]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    return rules.value_sets(items).select("key", F.array_join("values", "|").alias("values_found"), F.size("values").cast("long").alias("n_values"))


@query("q04_item_matcher_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def item_matcher_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, ItemIs("SU:c_mktsegment", "BUILDING"))


def _matched(spark: SparkSession, sf_dir: str, condition: ItemIs) -> DataFrame:
    """The orders of the customers whose item fulfils the condition."""
    items = rules.to_cells(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_mktsegment", "c_name"])
    items = items.select(F.col("c_custkey").alias("file_id"), F.lit("SUBJECT").alias("section"), F.col("column").alias("key"), "value")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(condition.files(items).withColumnRenamed("file_id", "o_custkey"), "o_custkey", "left_semi")


@query("q05_item_matcher_regex", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^(AUTO|MACH)'))")
def item_matcher_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, ItemLike("SU:c_mktsegment", "^(AUTO|MACH)"))


@query(
    "q06_unpivot_cells",
    " UNION ALL ".join(f"SELECT p_partkey AS row_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")),
)
def unpivot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "row_id")
    return rules.to_cells(part, ["row_id"], ["p_name", "p_brand", "p_type", "p_size"]).withColumnRenamed("column", "column_name")


EVENT_TYPES = ("click", "purchase", "view", "signup", "logout")


@query(
    "q07_pivot_table",
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in EVENT_TYPES) + " FROM events GROUP BY user_id",
)
def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("column")).agg(F.count("*").alias("value"))
    wide = rules.to_wide(counts, ["user_id"], list(EVENT_TYPES))
    return wide.select("user_id", *(F.coalesce(F.col(e), F.lit(0)).alias(f"n_{e}") for e in EVENT_TYPES))


@query("q08_anti_data_not_in_ssf", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def data_not_in_ssf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.not_in(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("q09_anti_documents_without_labels", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.not_in(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "q10_anti_names_both_directions",
    """
    WITH a AS (SELECT DISTINCT trim(p_name) AS name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'A'),
         r AS (SELECT DISTINCT trim(p_name) AS name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R')
    SELECT 'only_a' AS side, name FROM a WHERE name NOT IN (SELECT name FROM r)
    UNION ALL SELECT 'only_r', name FROM r WHERE name NOT IN (SELECT name FROM a)
    """,
)
def names_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on one side only, in both directions, over all lines of either flag."""
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A', 'R')")
    names = line.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.trim("p_name").alias("name"), "l_returnflag")
    return _sides(rules.one_side(names, ["name"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"))


def _sides(rows: DataFrame) -> DataFrame:
    return rows.withColumn("side", F.when(F.col("side") == "left", "only_a").otherwise("only_r"))


@query(
    "q46_anti_items_all_lines",
    """
    WITH i AS (SELECT l_returnflag AS flag, trim(p_name) AS name, CAST(l_orderkey AS VARCHAR) AS orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('A', 'R')),
         u AS (SELECT 'name' AS item, name AS value, flag FROM i UNION ALL SELECT 'order', orderkey, flag FROM i)
    SELECT 'only_a' AS side, * FROM (SELECT item, value FROM u WHERE flag = 'A' EXCEPT SELECT item, value FROM u WHERE flag = 'R')
    UNION ALL SELECT 'only_r', * FROM (SELECT item, value FROM u WHERE flag = 'R' EXCEPT SELECT item, value FROM u WHERE flag = 'A')
    """,
)
def items_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and orders on one side only, in both directions, over all lines."""
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A', 'R')")
    rows = line.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    both = F.explode(F.array(F.struct(F.lit("name").alias("item"), F.trim("p_name").alias("value")), F.struct(F.lit("order").alias("item"), F.col("l_orderkey").cast("string").alias("value"))))
    items = rows.select("l_returnflag", both.alias("i")).select("l_returnflag", "i.item", "i.value")
    return _sides(rules.one_side(items, ["item", "value"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"))


@query("q11_dup_after_first", "SELECT p_partkey, p_name, n FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n > 1")
def dup_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repeated(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], "p_partkey")


@query(
    "q12_dup_key_suffix",
    """
    SELECT event_id, CASE WHEN n = 0 THEN event_type ELSE event_type || '{{{_' || n || '_}}}' END AS raw_key
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events)
    """,
)
def dup_key_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.numbered_keys(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("event_id", "raw_key")


NA_SQL = ", ".join("'" + v.replace("'", "''") + "'" for v in COLUMN_NA)


@query(
    "q13_null_column",
    f"""
    SELECT l_orderkey, column_name FROM (
      SELECT l_orderkey, 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem
      UNION ALL SELECT l_orderkey, 'l_linestatus', l_linestatus FROM lineitem
    ) GROUP BY 1, 2 HAVING bool_and(value IS NULL) OR bool_and(coalesce(value IN ({NA_SQL}), false))
    """,
)
def null_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").unpivot(["l_orderkey"], ["l_returnflag", "l_linestatus"], "column_name", "value")
    return rules.null_columns(rules.column_profile(cells, ["l_orderkey", "column_name"], COLUMN_NA)).select("l_orderkey", "column_name")


@query(
    "q14_overbalanced",
    """
    WITH cells AS (
      SELECT 'c_negative' AS column_name, CAST(c_acctbal <= 0 AS VARCHAR) AS value FROM customer
      UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer
    ), n AS (SELECT column_name, value, count(*) AS n FROM cells GROUP BY 1, 2)
    SELECT column_name, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY 1 HAVING max(n) / sum(n) > 0.9 AND count(*) > 1
    """,
)
def overbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of several values in which one has more than nine tenths."""
    customer = table(spark, sf_dir, "customer")
    cells = customer.select(F.lit("c_negative").alias("column_name"), (F.col("c_acctbal") <= 0).cast("string").alias("value"))
    cells = cells.unionByName(table(spark, sf_dir, "labels").select(F.lit("toxic").alias("column_name"), F.col("toxic").cast("string").alias("value")))
    cells = cells.unionByName(customer.select(F.lit("c_mktsegment").alias("column_name"), F.col("c_mktsegment").alias("value")))
    return rules.one_value_columns(rules.column_profile(cells, ["column_name"], COLUMN_NA)).select("column_name", "most", "total")


@query("q15_dup_rows", "SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.equal_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"])


def _na_sql(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: The lists of what stands for a missing value, by their use.
NA_LISTS = {"column": COLUMN_NA, "schema": SCHEMA_NA, "metabolite": METABOLITE_NA}


@query(
    "q16_blank_names",
    " UNION ALL ".join(
        f"SELECT '{n}' AS na, l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'A'), 'NA') AS flag FROM lineitem WHERE coalesce(nullif(l_returnflag, 'A'), 'NA') IN ({_na_sql(v)})"
        for n, v in NA_LISTS.items()
    ),
)
def blank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose flag (NA in place of A) stands for a missing value, by each of the lists."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("NA").alias("flag"))
    out = None
    for name, values in NA_LISTS.items():
        part = rules.blank(rows, "flag", values).withColumn("na", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("q17_header_like_names", "SELECT conv_id, turn, role FROM conversations WHERE lower(trim(role)) IN ('user', 'samples', 'factors', 'system')")
def header_like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.trim("role").alias("name"))
    return rules.header_like(roles, "name", ("user", "samples", "factors", "system")).drop("name")


@query(
    "q18_factor_mismatch",
    """
    SELECT o_orderkey, o_orderstatus, s.status FROM orders LEFT JOIN (
      SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status FROM lineitem GROUP BY 1
    ) s ON o_orderkey = l_orderkey WHERE o_orderstatus IS DISTINCT FROM s.status
    """,
)
def factor_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.min("l_linestatus") == F.max("l_linestatus")
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(same, F.min("l_linestatus")).otherwise("P").alias("status"))
    return rules.mismatched(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), found, ["o_orderkey"], "o_orderstatus", "status", "left")


@query("q19_pair_mask", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'N') <> (l_linestatus = 'O')")
def pair_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unlike_masks(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber")


@query(
    "q21_value_integer",
    "SELECT p_partkey, p_size FROM part WHERE NOT contains(CAST(p_size AS VARCHAR), '.') AND TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) IS NOT NULL",
)
def value_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(Finder("size", kind="integer").values(F.col("p_size").cast("string"), na_matches=False)).select("p_partkey", "p_size")


@query(
    "q48_value_integer_all",
    "SELECT 'size' AS item, p_partkey AS id, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'key', c_custkey, CAST(c_custkey AS VARCHAR) FROM customer",
)
def value_integer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several kinds of values (sizes, keys, names and balances), all that are integers; balances have a point."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    kinds = ((part, "size", "p_partkey", "p_size"), (part, "name", "p_partkey", "p_name"), (customer, "key", "c_custkey", "c_custkey"), (customer, "balance", "c_custkey", "c_acctbal"))
    values = [t.select(F.lit(n).alias("item"), F.col(k).cast("long").alias("id"), F.col(c).cast("string").alias("value")) for t, n, k, c in kinds]
    rows = values[0].unionByName(values[1]).unionByName(values[2]).unionByName(values[3])
    return rows.filter(Finder("any", kind="integer").values(F.col("value"), na_matches=False))


@query(
    "q22_value_numeric",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) IS NOT NULL",
)
def value_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(is_numeric(F.split("o_orderpriority", "-")[0])).select("o_orderkey", "o_orderpriority")


@query("q23_value_regex", r"SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#(\d)[12]')")
def value_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(Finder("brand", pattern=r"Brand#(\d)[12]").values(F.col("p_brand"))).select("p_partkey", "p_brand")


@query(
    "q24_ids_classify",
    r"""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'AN' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0')
                           WHEN p_partkey % 3 = 1 THEN 'ST' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'X' || p_partkey END AS id,
           CASE WHEN p_partkey % 3 = 1 THEN 'study' ELSE 'analysis' END AS kind
    FROM part
    """,
)
def ids_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, key).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ST"), F.lpad(key, 6, "0"))).otherwise(F.concat(F.lit("X"), key))
    return table(spark, sf_dir, "part").select("p_partkey", full_id(raw).alias("id"), id_kind(raw).alias("kind"))


@query(
    "q25_lines_tokenize",
    """
    SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, line FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
    ) WHERE line <> ''
    """,
)
def lines_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")).withColumnRenamed("file_id", "doc_id")


@query(
    "q26_section_carry",
    """
    WITH t AS (
      SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS opens FROM conversations
    ) SELECT conv_id, turn, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS section FROM t
    """,
)
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    section = rules.carried(turns, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")))
    return turns.select("conv_id", "turn", F.coalesce(section, F.lit(-1)).alias("section"))


@query("q27_concat_items", "SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn NULLS FIRST, text) AS value FROM conversations GROUP BY 1, 2")
def concat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.joined_values(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text").withColumnRenamed("text", "value")


@query("q44_concat_whole_items", "SELECT lang, source, string_agg(text, chr(10) ORDER BY doc_id NULLS FIRST, text) AS value FROM documents GROUP BY 1, 2")
def concat_whole_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of each language and source, joined in the order of their ids."""
    return rules.joined_values(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", "text", "\n").withColumnRenamed("text", "value")


@query("q28_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


#: (column, keyword, argument) over the customer and part tables as items.
RULES = (
    ("c_mktsegment", "enum", "BUILDING|MACHINERY"), ("c_name", "pattern", r"0[0-4]$"), ("p_brand", "pattern", r"^Brand#[1-3]"), ("p_brand", "not pattern", r"[45]$"),
    ("p_type", "minLength", "12"), ("p_type", "maxLength", "16"), ("p_type", "not", "ECONOMY|PROMO"), ("p_size", "minimum", "5"), ("p_size", "maximum", "44"), ("p_comment", "required", ""),
)
_RULE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS keyword, '{a}' AS argument" for c, k, a in RULES)
_ITEMS_SQL = "items AS (" + " UNION ALL ".join(f"SELECT '{t[0]}' || {k} AS owner, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}" for t, k, cs in (("customer", "c_custkey", ("c_mktsegment", "c_name")), ("part", "p_partkey", ("p_brand", "p_type", "p_size"))) for c in cs) + ")"


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items(owner, column_name, value) of customers and parts, and the table of RULES."""
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    items = rules.to_cells(customer.withColumn("owner", F.concat(F.lit("c"), "c_custkey")), ["owner"], ["c_mktsegment", "c_name"])
    items = items.unionByName(rules.to_cells(part.withColumn("owner", F.concat(F.lit("p"), "p_partkey")), ["owner"], ["p_brand", "p_type", "p_size"]))
    return items.withColumnRenamed("column", "column_name"), spark.createDataFrame(list(RULES), "column_name string, keyword string, argument string")


@query(
    "q29_schema_rules",
    f"""
    WITH rules AS ({_RULE_SQL}), {_ITEMS_SQL}
    SELECT column_name, keyword, count(*) AS n FROM items JOIN rules USING (column_name)
    WHERE (keyword = 'enum' AND NOT list_contains(string_split(argument, '|'), value)) OR (keyword = 'pattern' AND NOT regexp_matches(value, argument))
       OR (keyword = 'not pattern' AND regexp_matches(value, argument)) OR (keyword = 'not' AND list_contains(string_split(argument, '|'), value))
       OR (keyword = 'minLength' AND length(value) < TRY_CAST(argument AS INTEGER)) OR (keyword = 'maxLength' AND length(value) > TRY_CAST(argument AS INTEGER))
       OR (keyword = 'minimum' AND TRY_CAST(value AS DOUBLE) < TRY_CAST(argument AS DOUBLE)) OR (keyword = 'maximum' AND TRY_CAST(value AS DOUBLE) > TRY_CAST(argument AS DOUBLE))
    GROUP BY 1, 2
    UNION ALL SELECT 'p_comment', 'required', count(*) FROM part
    """,
)
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items break each rule of a table of rules; a required key that no item has counts for every owner."""
    items, held = _ruled(spark, sf_dir)
    found = schema.broken_rules(items, held, ["column_name"]).groupBy("column_name", "keyword").agg(F.count("*").alias("n"))
    owners = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("owner"))
    needed = schema.lacking(owners, items, held.filter("keyword = 'required'").select("column_name"), "owner", ["column_name"])
    return found.unionByName(needed.groupBy("column_name").agg(F.count("*").alias("n")).withColumn("keyword", F.lit("required")))


@query(
    "q30_schema_pattern",
    f"WITH {_ITEMS_SQL} SELECT owner, column_name, value FROM items WHERE (column_name = 'c_name' AND NOT regexp_matches(value, '0[0-4]$')) OR (column_name = 'p_brand' AND NOT regexp_matches(value, '^Brand#[1-3]'))",
)
def schema_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that don't match the pattern of their column."""
    items, held = _ruled(spark, sf_dir)
    return schema.broken_rules(items, held.filter("keyword = 'pattern'"), ["column_name"]).select("owner", "column_name", "value")


@query("q31_schema_enum", f"WITH {_ITEMS_SQL} SELECT owner, value FROM items WHERE column_name = 'c_mktsegment' AND value NOT IN ('BUILDING', 'MACHINERY')")
def schema_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are none of their column's choices."""
    items, held = _ruled(spark, sf_dir)
    return schema.broken_rules(items, held.filter("keyword = 'enum'"), ["column_name"]).select("owner", "value")


@query(
    "q32_issue_summary",
    """
    SELECT tag, count(*) AS n, count(*) FILTER (severity = 'Warning') AS n_warnings FROM (
      SELECT CASE WHEN l_returnflag = 'R' THEN 'Error' ELSE 'Warning' END AS severity,
             unnest(CASE WHEN l_linestatus = 'O' THEN ['value', 'consistency'] ELSE ['value'] END) AS tag FROM lineitem
    ) GROUP BY tag
    """,
)
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("l_linestatus") == "O", F.array(F.lit("value"), F.lit("consistency"))).otherwise(F.array(F.lit("value")))
    severity = F.when(F.col("l_returnflag") == "R", "Error").otherwise("Warning")
    return rules.tag_counts(table(spark, sf_dir, "lineitem").select(severity.alias("severity"), tags.alias("tags")))


@query(
    "q33_url_parts",
    r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) AS path, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/') AS is_url FROM pages",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url_part(url, "PROTOCOL").alias("scheme"), url_part(url, "HOST").alias("host"), url_part(url, "PATH").alias("path"), is_url(url).alias("is_url"))


@query(
    "q34_results_struct",
    r"""
    SELECT p_partkey, p_name || '.txt' AS filename, CASE WHEN p_size % 2 = 0 THEN p_brand END AS units, CASE WHEN p_size % 3 = 0 THEN 'Yes' END AS has_mz,
           CASE WHEN p_size % 5 = 0 THEN 'No' END AS has_rt, CASE WHEN p_size % 7 = 0 THEN 'Minutes' END AS rt_units FROM part
    """,
)
def results_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results-file lines are written from the part table and read again."""
    opt = lambda n, key, v: F.when(F.col("p_size") % n == 0, F.concat(F.lit(f"\t{key}:"), v)).otherwise("")
    line = F.concat("p_name", F.lit(".txt"), opt(2, "UNITS", F.col("p_brand")), opt(3, "Has m/z", F.lit("Yes")), opt(5, "Has RT", F.lit("No")), opt(7, "RT units", F.lit("Minutes")))
    rows = table(spark, sf_dir, "part").select("p_partkey", results_file(line).alias("r"))
    return rows.select("p_partkey", "r.*")


@query("q35_render_lines")
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped into lines of at most 80 characters at their spaces."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(wrap(F.col("text"), 80)).alias("line_no", "line"))
    return rows


@query(
    "q36_canonical_order",
    """
    SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY
      CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 999 END, o_orderkey) AS pos FROM orders
    """,
)
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return rules.in_order(orders, "o_orderpriority", ("1-URGENT", "3-MEDIUM", "2-HIGH"), ["o_custkey"], "o_orderkey").drop("o_custkey")


@query(
    "q37_polarity_conflict",
    "SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')",
)
def polarity_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rules.both_values(rows, ["o_custkey"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")


@query(
    "q38_archive_compression",
    r"""
    SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'zip' WHEN page_id % 6 = 1 THEN 'tar.gz' WHEN page_id % 6 = 2 THEN 'tar.bz2' WHEN page_id % 6 = 3 THEN 'gz'
                         WHEN page_id % 6 = 4 THEN 'tar' ELSE '' END AS compression FROM pages
    """,
)
def archive_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.get(F.array(*map(F.lit, (".zip", ".tar.gz", ".tar.bz2", ".gz", ".tar", ".html"))), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", compression(F.concat("url", ends)).alias("compression"))
