"""From documents to packed training sequences: toxic texts go, copies go, near copies go, the rest is packed.

All stages take a table of documents and read its columns DOCUMENTS: one that is missing counts as null, others are left
out. A null text counts as empty. Rows are told apart by doc_id and text, so rows that share a doc_id but not the text
are different documents, and a null doc_id is a value like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm import exact_dedup, near_dedup, packing, toxicity
from assayspark.llm.shared import Scratch, keep, table

#: Rows (of 16 bytes each) that are sent to the texts; more are shuffled.
SENT_ROWS = 1_000_000
DOCUMENTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in DOCUMENTS.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go, each row by its own text; repeated rows go or stay together."""
    return toxicity.without_toxic(documents(docs), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the one with most code points stays (then the smallest doc_id), as one
    row: repeated rows of one doc_id and text become one."""
    docs = documents(docs)
    return _decided(docs, exact_dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by shingles of five words at a similarity of 0.8 or more, the one with the smallest doc_id stays.

    Five words are the rule for stages of this kind; a search of two words (as op1 has) also links texts in which every
    tenth word or so is another, which are still worth their tokens in training. Texts without words stay.
    """
    docs = documents(docs)
    return _decided(docs, near_dedup.near_duplicates(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left and their places in sequences of 1024 tokens; repeated rows are packed each."""
    return packing.pack(documents(docs))


def _decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay by decided(doc_id, text_hash, stays), a row for each row of docs; of rows that are equal in
    doc_id and text, one (that with the least lang, source and n_chars). Few enough rows are sent to the texts."""
    decided = keep(decided.select("doc_id", "text_hash", "stays"), "decided")
    gone = decided.filter("NOT stays").groupBy("doc_id", "text_hash").agg(F.lit(1).alias("n"))
    again = decided.filter("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").withColumn("n", F.lit(2))
    marked = keep(gone.unionByName(again).withColumnsRenamed({"doc_id": "mark_id", "text_hash": "mark_hash"}), "marked")
    counts = {r["n"]: r["rows"] for r in marked.groupBy("n").agg(F.count("*").alias("rows")).collect()}
    if sum(counts.values()) <= SENT_ROWS:
        marked = F.broadcast(marked)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    docs = docs.join(marked, docs.doc_id.eqNullSafe(marked.mark_id) & (docs.text_hash == marked.mark_hash), "left")
    out = docs.filter("n IS NULL").select(*DOCUMENTS)
    if counts.get(2):
        one = docs.filter("n = 2").groupBy("doc_id", "text_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("d"))
        out = out.unionByName(one.select("doc_id", "d.text", "d.lang", "d.source", "d.n_chars"))
    return out


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL cannot express the classifier or the tokenizer; the tests hold each stage against its operator and brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage left is taken away once the next one has been written."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
