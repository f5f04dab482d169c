"""Exact duplicates by a cuckoo-filter index of live digests.

Texts are equal when their digests are: sha256 of the text without the characters space and U+0009 to U+000D.
Digests are dealt out to shards by their value, as many as hold SHARD_KEYS digests each. Each shard holds a cuckoo filter
whose slots carry a short fingerprint and the row of the stored key; a fingerprint hit counts only if the whole stored
digest, which stands for the content in its bucket, is equal. A full filter is rebuilt at twice the size from the stored
keys. Keys can be taken out again, so the index serves live collections.

Before anything is shuffled, each task collapses its own copies through an index of its own, so a text that makes up
a third of all rows arrives at its shard as one row for each task. On the way back to the rows, the digests that make up
a HOT_SHARE of them or more (so there are few) are sent to the rows; all others are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import Scratch, keep, map_rows

SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4  # in a bucket
MOST_KICKS = 200
#: Digests in a task's own index before it hands them on and starts anew.
TASK_KEYS = 500_000
#: Digests in a shard, about: some 150 MB.
SHARD_KEYS = 500_000
#: A digest of one in so many rows is hot. There are at most so many of them, of some 100 bytes each.
HOT_SHARE = 20_000
STATE = "digest binary, n_rows long, best_chars long, best_id long, best_hash long"


class CuckooIndex:
    """A cuckoo filter over whole stored digests: insert, find and delete.

    find() and insert() return the row of the stored key, so the caller can keep values beside it.
    """

    def __init__(self, buckets: int = 256):
        self.keys: list[bytes | None] = []
        self.free: list[int] = []
        self.resized = 0
        self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = np.zeros(buckets * SLOTS, dtype=np.uint16).tolist()  # 0: empty
        self.rows = [0] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        """The second bucket, from the first and the fingerprint alone, and back."""
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int | None:
        mark, first, second = self._places(digest)
        prints, rows, keys = self.prints, self.rows, self.keys
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[slot] == mark:
                    if keys[rows[slot]] == digest:
                        return rows[slot]
                    self.false_hits += 1
        return None

    def insert(self, digest: bytes) -> tuple[int, bool]:
        """The key's row, and whether it is new."""
        if (row := self.find(digest)) is not None:
            return row, False
        if self.free:
            self.keys[row := self.free.pop()] = digest
        else:
            row = len(self.keys)
            self.keys.append(digest)
        if not self._put(digest, row):
            self._resize()
        return row, True

    def _put(self, digest: bytes, row: int) -> bool:
        mark, first, second = self._places(digest)
        prints, rows = self.prints, self.rows
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[slot]:
                    prints[slot], rows[slot] = mark, row
                    return True
        bucket = second
        for kick in range(MOST_KICKS):
            slot = bucket * SLOTS + (kick * 7 + row) % SLOTS
            mark, prints[slot] = prints[slot], mark
            row, rows[slot] = rows[slot], row
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[slot]:
                    prints[slot], rows[slot] = mark, row
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored keys."""
        done = False
        while not done:
            self.resized += 1
            self._clear(2 * (self.mask + 1))
            done = all(self._put(key, row) for row, key in enumerate(self.keys) if key is not None)

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[row := self.rows[slot]] == digest:
                    self.prints[slot] = 0
                    self.keys[row] = None
                    self.free.append(row)
                    return True
        return False


class _Held:
    """An index and, beside each key, its number of rows and the row that stays."""

    def __init__(self):
        self.index, self.n, self.best = CuckooIndex(), [], []

    def add(self, digest: bytes, n: int, chars: int, row_id: int | None, text_hash: int) -> None:
        row, new = self.index.insert(digest)
        best = (-chars, row_id is None, row_id or 0, text_hash)
        if not new:
            self.n[row] += n
            self.best[row] = min(self.best[row], best)
        elif row < len(self.n):
            self.n[row], self.best[row] = n, best
        else:
            self.n.append(n)
            self.best.append(best)

    def batches(self, most: int = 50_000) -> Iterator[pa.RecordBatch]:
        live = [i for i, key in enumerate(self.index.keys) if key is not None]
        for at in range(0, len(live), most):
            rows = live[at : at + most]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.index.keys[i] for i in rows], pa.binary()),
                    pa.array([self.n[i] for i in rows], pa.int64()),
                    pa.array([-self.best[i][0] for i in rows], pa.int64()),
                    pa.array([None if self.best[i][1] else self.best[i][2] for i in rows], pa.int64()),
                    pa.array([self.best[i][3] for i in rows], pa.int64()),
                ],
                names=["digest", "n_rows", "best_chars", "best_id", "best_hash"],
            )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest and text_hash (xxhash64 of the original text) of every row;
    a null text counts as empty."""

    def work(rows: pa.RecordBatch) -> dict:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        return {
            "doc_id": rows.column(0),
            "n_chars": [len(t) for t in texts],
            "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, SPACE)).digest() for t in texts],
            "text_hash": rows.column(2),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return map_rows(rows, "text", "doc_id long, n_chars long, digest binary, text_hash long", work)


def _own_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows (doc_id, n_chars, digest, text_hash) as states, its own copies collapsed."""
    held = _Held()
    for batch in batches:
        for row_id, chars, digest, text_hash in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            held.add(digest, 1, chars, row_id, text_hash)
            if len(held.index) >= TASK_KEYS:
                yield from held.batches()
                held = _Held()
    yield from held.batches()


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All states and removals of a shard as its live states."""
    held, gone = _Held(), []
    for batch in batches:
        for digest, n, chars, row_id, text_hash in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if n < 0:
                gone.append(digest)
            else:
                held.add(digest, n, chars, row_id, text_hash)
    for digest in gone:
        held.index.delete(digest)
    yield from held.batches()


def _own(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_chars", "digest", "text_hash").mapInArrow(_own_copies, STATE)


def _sharded(states: DataFrame) -> DataFrame:
    """States dealt out to shards of about SHARD_KEYS, and each shard's live states."""
    spark = states.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-states.count() // SHARD_KEYS))
    return states.repartition(shards, "digest").mapInArrow(_shard, STATE)


def build_index(rows: DataFrame) -> DataFrame:
    """The index of digests(): a row for each live digest with its number of rows and the row that stays."""
    return _sharded(keep(_own(rows), "states"))


def update_index(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The index after adding the rows of digests() in `added` and then taking out the digests in `removed`."""
    if added is not None:
        index = index.unionByName(_own(added))
    if removed is not None:
        gone = removed.select("digest").distinct()
        index = index.unionByName(gone.selectExpr("digest", "-1L AS n_rows", "0L AS best_chars", "CAST(NULL AS LONG) AS best_id", "0L AS best_hash"))
    return _sharded(keep(index, "states"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_hash (xxhash64 of the text) and stays.

    Of equal texts, the one with the most code points stays, then the one with the smallest doc_id, then the one with
    the smallest text_hash. Null texts count as empty; empty texts and texts of white space only are equal to each other.
    A null doc_id comes after all others. kept says that the row has that doc_id and length, stays that its text is that
    very text too. Repeated rows (same doc_id, same text) count in group_size; if such a row stays, each of its copies is
    marked as kept and stays. An empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(digests(docs), "digests")
    index = scratch.keep(build_index(rows), "index")
    hot = F.broadcast(index.filter(F.col("n_rows") * HOT_SHARE >= rows.count()))
    out = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(index, "digest"))
    kept = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_chars"))
    return out.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
        (kept & (F.col("text_hash") == F.col("best_hash"))).alias("stays"),
    )
