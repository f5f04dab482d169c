"""How far the sources of a language diverge: word shares held against those of the other sources and of the language.

Terms are counted in tasks and dealt out to shards by a hash of language and term; a shard is a partition, and DuckDB runs
its SQL over it as the rows arrive, within MEMORY and spilling beyond. A first pass sums counts and keeps the terms that
stand in LEAST_DOCUMENTS documents of their language or more; Spark sums the totals of each group (language and source). A second
pass over the kept counts gives partial pair sums and the shard's leading terms of each group; Spark merges both and ranks.

Pair sums go over all kept terms, yet only pairs of sources that both hold a term are joined. With f the value of a term, p0 the
share of a group for a count of 0, and s and t two groups:

    sum f(ps, pt) = V f(p0s, p0t) + sum over s's terms of (f(ps, p0t) - f(p0s, p0t)) + sum over t's terms of (f(p0s, pt) - f(p0s, p0t))
                    + sum over shared terms of (f(ps, pt) - f(ps, p0t) - f(p0s, pt) + f(p0s, p0t))

The second and third sums depend on how many terms have which count, so shards hand those on as a histogram. All values
are integers, so the split is exact.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayspark.llm.shared import Scratch, slices

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
RANKS = 200
#: Distinct (group, term) counts that a task holds before it hands them on, and the memory of a shard's DuckDB beyond which it spills.
COUNTED = 600_000
MEMORY = "300MB"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])
_JOINED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("n_all", pa.int64()), ("n_lang", pa.int64()), ("v", pa.int64())])

_KEPT = f"""
WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(df)::BIGINT AS df FROM arrived GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total, min(source) AS first FROM c GROUP BY ALL HAVING sum(df) >= {LEAST_DOCUMENTS})
SELECT c.lang, c.source, c.term, c.n, k.total, c.source = k.first AS first FROM c JOIN k ON c.lang = k.lang AND c.term = k.term
"""
_SHARES = f"""
CREATE TABLE c AS SELECT lang, source, term, n, (1 + ({SCALE}::HUGEINT * (n + 1)) // (n_all + v))::BIGINT AS p, 1 + {SCALE} // (n_all + v) AS p0,
  (1 + ({SCALE}::HUGEINT * (total + 1)) // (n_lang + v))::BIGINT AS q FROM arrived
"""
_SUMS = (
    """
    SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS n,
      sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::DECIMAL(38, 0) AS value
    FROM c AS a JOIN c AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    """,
    "SELECT 'count' AS kind, lang, source, '' AS item, n, count(*)::DECIMAL(38, 0) AS value FROM c GROUP BY ALL",
    f"""
    SELECT 'term' AS kind, lang, source, term AS item, 0::BIGINT AS n, f(p, q)::DECIMAL(38, 0) AS value FROM c WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {RANKS}
    """,
)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), df (documents) of the task's texts, handed on when many are held."""
    groups: dict[tuple, dict[bytes, list[int]]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in groups.items():
            n, df = zip(*terms.values(), strict=True)
            names = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], schema=_COUNTED)
        groups.clear()

    for batch in batches:
        for rows in slices(batch, "text"):
            for lang, source, text in zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own: dict[bytes, int] = {}
                for w in text.encode().translate(_LETTERS).split():
                    own[w] = own.get(w, 0) + 1
                if not own:
                    continue
                terms = groups.setdefault((lang, source), {})
                before = len(terms)
                for w, n in own.items():
                    if (x := terms.get(w)) is None:
                        terms[w] = [n, 1]
                    else:
                        x[0] += n
                        x[1] += 1
                held += len(terms) - before
                if held >= COUNTED:
                    yield from out()
                    held = 0
    yield from out()


def _shard(schema: pa.Schema, before: list[str], queries: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that runs SQL over a partition's rows (table `arrived`) and hands on what the queries give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.register("arrived", pa.RecordBatchReader.from_batches(schema, batches))
            for sql in before:
                con.execute(sql)
            for sql in queries:
                yield from con.sql(sql).to_arrow_reader(20_000)

    return run


def _share(n: Column, v: Column, n_all: Column) -> Column:
    """p of a count in a group, 1 where its language keeps no term."""
    scaled = (F.lit(SCALE).cast("decimal(10, 0)") * (n + 1).cast("decimal(20, 0)")).cast("decimal(38, 0)")
    return F.when(n_all + v > 0, F.call_function("div", scaled, n_all + v) + 1).otherwise(F.lit(1)).cast("long")


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language (part `pair`, all of them) and the
    terms that it holds more often than its language does (part `term`, the first RANKS).

    Null text, lang and source count as ''. Terms are runs of letters and characters beyond ASCII, A-Z in lower case, of whole
    texts. Every row is a document, repeated rows and null doc_ids too. A group without terms, or whose language keeps
    none, has pairs of value 0 or of its counts of 0. Equal values are ranked by item in UTF-8 order. An empty table gives an empty result;
    further columns, whatever their names, are ignored. Texts of any length are read in one pass; only distinct terms are held.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counts = rows.mapInArrow(_counts, "lang string, source string, term string, n long, df long")
    kept = counts.repartition("lang", "term").mapInArrow(_shard(_COUNTED, [], (_KEPT,)), "lang string, source string, term string, n long, total long, first boolean")
    kept = scratch.keep(kept, "kept")

    # a row for each group
    n_all = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count_if("first").alias("v_part"))
    groups = rows.select("lang", "source").distinct().join(n_all, ["lang", "source"], "left").fillna(0, ["n_all", "v_part"])
    langs = groups.groupBy("lang").agg(F.sum("n_all").alias("n_lang"), F.sum("v_part").alias("v"))
    groups = groups.drop("v_part").join(langs, "lang").withColumn("p0", _share(F.lit(0), F.col("v"), F.col("n_all")))
    groups = scratch.keep(groups, "groups")

    joined = kept.select("lang", "source", "term", "n", "total").join(groups.select("lang", "source", "n_all", "n_lang", "v"), ["lang", "source"])
    before = ["CREATE MACRO f(a, b) AS (a - b) * (a - b) // b", _SHARES]
    sums = joined.select(*_JOINED.names).repartition("lang", "term").mapInArrow(_shard(_JOINED, before, _SUMS), "kind string, lang string, source string, item string, n long, value decimal(38, 0)")
    sums = scratch.keep(sums, "sums")

    one, other = groups.alias("s"), groups.select("lang", F.col("source").alias("item"), F.col("n_all").alias("item_n"), F.col("p0").alias("item_p0"))
    pairs = one.join(other, "lang").filter("source <> item")
    zero = _value(F.col("p0"), F.col("item_p0"))
    none = pairs.select("lang", "source", "item", (F.col("v") * zero.cast("decimal(20, 0)")).cast("decimal(38, 0)").alias("value"))
    counted = sums.filter("kind = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("k"))
    single = counted.join(pairs, ["lang", "source"])  # as many rows as the group has different counts, for each other source
    p, back = _share(F.col("n"), F.col("v"), F.col("n_all")), _value(F.col("item_p0"), F.col("p0"))
    there = (F.col("k") * (_value(p, F.col("item_p0")) - zero).cast("decimal(20, 0)")).cast("decimal(38, 0)")
    here = (F.col("k") * (_value(F.col("item_p0"), p) - back).cast("decimal(20, 0)")).cast("decimal(38, 0)")
    single = single.groupBy("lang", "source", "item").agg(F.sum(there).alias("there"), F.sum(here).alias("here"))
    single = single.select("lang", F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("here").alias("value")))).alias("x")).select("lang", "x.*")
    pair = none.unionByName(single).unionByName(sums.filter("kind = 'pair'").select("lang", "source", "item", "value"))
    pair = pair.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))
    term = sums.filter("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"), F.lit("term").alias("part"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = [x.withColumn("rank", F.row_number().over(ranked)) for x in (pair, term)]
    return out[0].unionByName(out[1].filter(F.col("rank") <= RANKS)).select("lang", "source", "part", "item", "value", "rank")
