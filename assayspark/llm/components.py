"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import Scratch

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of links(a, b); nodes without links don't appear.

    Each round joins every node's larger neighbours to its smallest neighbour (large star), then every node's smaller
    neighbours to the smallest of them (small star). A round is two aggregations and two joins by node; the rows that
    a node with very many links has are summed before the shuffle and split by the skew join after it.
    """
    scratch = Scratch(links.sparkSession)
    links = scratch.keep(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").select("a", "b").distinct(), "links")
    last = None
    for n in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        large = scratch.keep(large, f"large-{n}")  # every link points to a smaller node
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "least").filter("x <> least").select(F.col("x").alias("a"), F.col("least").alias("b"))
        links = scratch.keep(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), f"links-{n}")
        scratch.drop(f"large-{n}", f"links-{n - 1}" if n else "links")
        now = links.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) AS decimal(38, 0))"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"links have not settled after {MOST_ROUNDS} rounds")
    ends = links.groupBy("a").agg(F.min("b").alias("component"))
    return ends.select(F.col("a").alias("node"), "component").unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
