"""Chat formatting of maximal conversations, with DataFrame operations only.

Chat logs hold cumulative snapshots: the same conversation logged anew after every turn. The hash of each prefix of
turns is a running exclusive-or of hashes that carry the turn's place, kept twice with different seeds (128 bits). A
conversation whose whole hash is a proper prefix's hash of another one is a snapshot of it; an anti-join leaves the
maximal ones, which are rendered. Copies and prefixes are summed by hash before they meet, so a first turn or a whole
conversation that very many rows share is one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands before the role, between role and text, and after the text of a turn.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1, in the order of turn, role and text), role, text, n_turns and the prefix hashes a, b."""
    turns = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conversation = Window.partitionBy("conv_id")
    order = conversation.orderBy("turn", "role", "text")
    turns = turns.withColumns({"place": F.row_number().over(order).cast("long"), "n_turns": F.count("*").over(conversation)})
    running = conversation.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "place", "role", "text")).over(running)
    return turns.withColumns({"a": hashed(1), "b": hashed(2)})


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of each conversation that is no proper prefix of another; of equal ones that with
    the smallest conv_id (a null one comes last), n_copies of them there are."""
    whole = prefixes.filter("place = n_turns").groupBy("a", "b").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("unknown"), "conv_id")).alias("first"), F.first("n_turns").alias("n_turns"), F.count("*").alias("n_copies")
    )
    shorter = prefixes.filter("place < n_turns").select("a", "b").distinct()
    return whole.join(shorter, ["a", "b"], "left_anti").select("first.conv_id", "n_turns", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    before, between, after = map(F.lit, TEMPLATE)
    return F.concat(before, role, between, text, after)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of each maximal conversation.

    Turns follow each other by turn number (nulls first), then role, then text; a turn that is there twice counts twice.
    A null role or text is empty. Rows without conv_id make up one conversation. An empty table gives an empty result;
    further columns are ignored.
    """
    prefixes = prefix_hashes(turns)
    kept = maximal(prefixes).withColumnRenamed("conv_id", "kept_id")
    own = prefixes.select("conv_id", "place", rendered(F.col("role"), F.col("text")).alias("part"))
    own = own.join(kept, own.conv_id.eqNullSafe(kept.kept_id)).groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    return own.select("conv_id", "n_turns", "n_copies", F.array_join("parts.part", "").alias("text"))
