"""Ranked lexical search with WAND over shards of documents.

The queries' terms are the vocabulary; a first pass over the texts writes, for each document, its length and which of these
terms it holds how often. Numbers of documents and terms for the weights are summed from that table. A second pass reads
it: a shard is a run of a task's documents, turned into posting lists in ascending order of doc_id. Each list has a maximum
impact (the highest part of a score that its term adds in this shard). For a query, the lists are put in order of these;
where all lists from one on can't reach the threshold of the heap together, a document needs one of those before it. So the
next pivots are the documents of those lists alone, and the long lists of common words are looked at for pivots only, and
for as long as what a pivot has and what the lists left may still add beats the threshold. Documents between pivots are
never looked at. Pivots are taken in growing runs, as numpy works on many at once.

The heaps of all shards are merged by Spark, and are exact: a document left out could not have been among the first.

Queries are sent to the tasks in blocks of about BLOCK_TERMS terms (one query is never split), each with passes of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayspark.llm.shared import Scratch, slices

FIRST = 50
BLOCK_TERMS = 200_000
#: A shard ends with the document that brings it to so many postings; a run of pivots begins and ends with so many documents.
SHARD_POSTINGS = 3_000_000
RUN, LONGEST_RUN = 512, 65_536
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode().translate(_CLEAN).split()


@dataclass
class Query:
    """A block of queries as its tasks need it."""

    items: list[tuple[int | None, np.ndarray]]  # item_id and its terms' numbers
    weights: np.ndarray  # by the term's number
    documents: int = 0  # N
    length: int = 0  # L


@dataclass
class Shard:
    """Posting lists: documents from..to of a term are docs[starts[t]:starts[t + 1]], ascending, with what the term adds to their scores."""

    ids: list[int | None]
    docs: np.ndarray
    impacts: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(batch: pa.Table, query: Query) -> Shard:
        batch = batch.sort_by([("doc_id", "ascending")])  # nulls come last here
        ids, n = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
        nulls = sum(x is None for x in ids)
        place = (np.arange(len(ids)) + nulls) % max(1, len(ids))  # and first where scores are equal
        lists = batch.column("terms").combine_chunks()
        of = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), batch.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = np.array([50 + 50 * x * query.documents // query.length for x in n], dtype=np.int64)[of]
        impact = query.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        docs = place[of]
        order = np.lexsort((docs, term))
        ids = ids[len(ids) - nulls :] + ids[: len(ids) - nulls]
        return Shard(ids, docs[order], impact[order], np.searchsorted(term[order], np.arange(len(query.weights) + 1)))

    def best(self, wanted: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the `first` highest-scoring documents for the wanted terms, in any order."""
        lists = [(int(x.max()), self.docs[a:b], x) for a, b in zip(self.starts[wanted], self.starts[wanted + 1], strict=True) if b > a and (x := self.impacts[a:b]).any()]
        lists.sort(key=lambda x: (-x[0], len(x[1])))
        rest = np.concatenate([np.cumsum([x[0] for x in lists][::-1])[::-1], [0]]).astype(np.int64)  # what lists i.. add at most
        ends, at, width, least = [0] * len(lists), 0, RUN, 0
        docs = scores = np.zeros(0, dtype=np.int64)
        while True:
            needed = int(np.searchsorted(-rest, -least))  # lists from here on can't beat the threshold together
            begins = [int(np.searchsorted(d[ends[i] :], at)) + ends[i] for i, (_, d, _) in enumerate(lists[:needed])]
            begins = [x if x < len(lists[i][1]) else None for i, x in enumerate(begins)]
            ahead = [int(lists[i][1][x]) for i, x in enumerate(begins) if x is not None]
            if not ahead:
                return docs, scores
            at = min(ahead) + width
            runs = []
            for i, begin in enumerate(begins):
                if begin is not None:
                    ends[i] = begin + int(np.searchsorted(lists[i][1][begin:], at))
                    runs.append((i, begin, ends[i]))
            pivots = np.unique(np.concatenate([lists[i][1][a:b] for i, a, b in runs]))
            got = np.zeros(len(pivots), dtype=np.int64)
            for i, a, b in runs:
                got[np.searchsorted(pivots, lists[i][1][a:b])] += lists[i][2][a:b]
            for i in range(needed, len(lists)):
                beats = got + rest[i] > least
                if not beats.all():
                    pivots, got = pivots[beats], got[beats]
                if not len(pivots):
                    break
                of, impacts = lists[i][1:]
                found = np.minimum(np.searchsorted(of, pivots), len(of) - 1)
                got += np.where(of[found] == pivots, impacts[found], 0)
            beats = got > least
            docs, scores = np.concatenate([docs, pivots[beats]]), np.concatenate([scores, got[beats]])
            if len(docs) >= first:
                top = np.lexsort((docs, -scores))[:first]
                docs, scores = docs[top], scores[top]
                least = int(scores[-1])
            width = min(2 * width, LONGEST_RUN)


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of the documents with a term of any kind."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    words = terms(text)
                    if words:
                        counts = Counter(map(number, words))
                        counts.pop(None, None)
                        out.append((doc_id, len(words), list(counts), list(counts.values())))
                columns = zip(*out, strict=True) if out else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<long>")


def _heaps(index: DataFrame, query: Query, first: int) -> DataFrame:
    """item_id, doc_id, score: the heap of each query and shard."""
    sent = index.sparkSession.sparkContext.broadcast(query)
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            shard = Shard.of(pa.Table.from_batches(held), sent.value)
            for item_id, wanted in sent.value.items:
                places, scores = shard.best(wanted, first)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(places), pa.int64()), pa.array([shard.ids[p] for p in places.tolist()], pa.int64()), pa.array(scores)], schema=schema)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= SHARD_POSTINGS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return index.mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score: for each item, its `first` highest-scoring documents with a score above 0, all if fewer.

    Null and empty texts, and those without a term, are no documents and no queries. Rows with one item_id are one item, whose terms
    are those of all its rows, once each; a null item_id is an item. Each row of docs is a document: repeated rows are ranked each,
    a null doc_id before others of the same score. Equal scores are in ascending order of doc_id. An empty table of either
    kind gives an empty result; further columns are ignored. Texts are read whole, whatever their length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                pairs = [(i, w.decode()) for i, text in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True) for w in set(terms(text))]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["item_id", "term"])

    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    wanted = scratch.keep(wanted.mapInArrow(words, "item_id long, term string").distinct(), "queries")
    blocks, out = max(1, math.ceil(wanted.count() / BLOCK_TERMS)), None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about BLOCK_TERMS
        vocabulary = {w: i for i, w in enumerate(sorted({r["term"].encode() for r in rows}))}
        of: dict[int | None, list[int]] = {}
        for r in rows:
            of.setdefault(r["item_id"], []).append(vocabulary[r["term"].encode()])
        query = Query([(i, np.array(sorted(t))) for i, t in of.items()], np.zeros(len(vocabulary), dtype=np.int64))
        index = scratch.keep(_index(docs, vocabulary), f"index-{block}")
        query.documents, query.length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # as many as the vocabulary
            query.weights[r["term"]] = math.floor(1000 * math.log((2 * query.documents + 2) / (2 * r["df"] + 1)))
        heaps = scratch.keep(_heaps(index, query, first), f"heaps-{block}")
        out = out.unionByName(heaps) if out is not None else heaps
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    out = out.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= first)
    return out.select("item_id", "rank", "doc_id", "score")
