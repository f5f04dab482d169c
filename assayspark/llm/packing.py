"""Best-fit packing by bin completion, over a histogram of lengths.

Pieces of one length are alike, so a packing of all pieces is a packing of the histogram of their lengths, which has at
most `size` entries however many rows there are. It is planned on the driver: around the largest length left, the
undominated fillings are searched by branch and bound, and the filling found is repeated as often as the counts allow.
The search for a filling ends after STEPS (None: never, so the filling found is the best). Whole plans are restarts: the
plan by best fit is the first incumbent, then up to TRIES plans that pass over some full fillings; a plan that cannot need
fewer sequences than the incumbent is cut off, and one that meets the lower bound ends the search. Plans are not searched
exhaustively, so one that misses the bound may not be the best; sequences used and the bound are in report().

Each piece then finds its place by its rank among the pieces of its length: ranks are counted in the tasks that write
the pieces and shifted by the counts of the tasks before, so no length needs to be gathered anywhere.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayspark.llm.shared import keep, slices

SIZE = 1024
END_ID = 2
#: The ranks of byte_bpe_50k.json, read by a faster library; the tests hold its ids against the other's on random texts.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Search steps for one filling, and tries of whole plans.
STEPS, TRIES = 4_000, 6

Filling = tuple[tuple[int, int], ...]  # (length, how many)


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Callable[[str], list[int]]:
    """Ids of a text as ordinary text, from the vocabulary's ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole unless longer than size; then the first may be shorter."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, place long"


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The pieces of all documents; place counts the pieces of a length within the task (chunk) that made them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        seen, chunk = [0] * (size + 1), TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, "text"):
                out: list[list] = [[] for _ in range(7)]
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = array("I", encode(text or ""))
                    ids.append(end_id)
                    for k, (start, length) in enumerate(cut(len(ids), size)):
                        crc = zlib.crc32(np.asarray(ids[start : start + length], dtype="<u4"))
                        for column, value in zip(out, (doc_id, k, start, length, crc, chunk, seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


def best_fit(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """The largest that fits, again and again."""
    filling = []
    for x in lengths:
        if x <= room and (k := min(counts[x], room // x)):
            filling.append((x, k))
            room -= x * k
    return filling


def complete(room: int, lengths: list[int], counts: dict[int, int], skip: int = 0, steps: int | None = STEPS) -> list[tuple[int, int]]:
    """A filling of room with the least waste, or after so many steps the best found; lengths from large to small, all with counts.

    Branch and bound from large to small: the best-fit filling is the incumbent, `reach` bounds the waste of every
    branch from below (sums that the smaller lengths can make, were there enough of each), and a filling with no waste
    ends the search. Fillings with a larger length stand first, so a found one is not dominated: no length in it can
    be swapped for a larger one, or joined by a further one, at the same waste. skip: pass over so many full fillings.
    """
    lengths = [x for x in lengths if x <= room]
    reach = [0] * len(lengths) + [1]  # bit s: sum s can be made of lengths[i:]
    full = (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        sums, x = reach[i + 1], lengths[i]
        for _ in range(min(counts[x], room // x).bit_length()):
            sums |= (sums << x) & full
            x *= 2
        reach[i] = sums
    best = best_fit(room, lengths, counts)
    least = room - sum(x * k for x, k in best)
    left_steps = math.inf if steps is None else steps

    def search(i: int, left: int, filling: list[tuple[int, int]]) -> bool:
        nonlocal best, least, left_steps, skip
        left_steps -= 1
        if left < least or (left == least == 0):
            if left == 0 and skip:
                skip -= 1
                return False
            best, least = list(filling), left
            if left == 0:
                return True
        if left_steps <= 0:
            return True
        while i < len(lengths):
            within = reach[i] & ((1 << (left + 1)) - 1)
            if left - (within.bit_length() - 1) >= (least or 1):
                return False  # no branch from here on wastes less than the incumbent
            x = lengths[i]
            for k in range(min(counts[x], left // x), 0, -1):
                filling.append((x, k))
                if search(i + 1, left - x * k, filling):
                    return True
                filling.pop()
            i += 1
        return False

    if least or skip:
        search(0, room, [])
    return best


def least_sequences(counts: dict[int, int], size: int) -> int:
    """No packing needs fewer: by the sum of lengths, and by those that cannot share with what is over size - t."""
    bound = -(-sum(x * n for x, n in counts.items()) // size)
    for t in range(0, size // 2 + 1):
        large = sum(n for x, n in counts.items() if x > size - t)
        middle = sum(n for x, n in counts.items() if size // 2 < x <= size - t)
        room = middle * size - sum(x * n for x, n in counts.items() if size // 2 < x <= size - t)
        small = sum(x * n for x, n in counts.items() if t <= x <= size // 2)
        bound = max(bound, large + middle + max(0, -(-(small - room) // size)))
    return bound


def plan(counts: dict[int, int], size: int = SIZE, tries: int = TRIES, steps: int | None = STEPS) -> list[tuple[Filling, int]]:
    """Fillings of sequences with how often each is used; together they hold every length as often as counts says."""
    bound = least_sequences(counts, size)
    best, fewest = None, float("inf")
    for attempt in range(tries + 1):
        left = {x: n for x, n in sorted(counts.items(), reverse=True) if n}
        found, used, volume = [], 0, sum(x * n for x, n in left.items())
        while left:
            lengths = list(left)
            top = lengths[0]
            left[top] -= 1
            room = size - top
            rest = [x for x in lengths if left[x]]
            fill = best_fit(room, rest, left) if attempt == 0 else complete(room, rest, left, skip=(attempt - 1) if len(found) % attempt == 0 else 0, steps=steps)
            left[top] += 1
            filling: dict[int, int] = {top: 1}
            for x, k in fill:
                filling[x] = filling.get(x, 0) + k
            times = min(left[x] // k for x, k in filling.items())
            for x, k in filling.items():
                left[x] -= k * times
                if not left[x]:
                    del left[x]
            found.append((tuple(filling.items()), times))
            used += times
            volume -= times * sum(x * k for x, k in filling.items())
            if used - (-volume // size) >= fewest:
                break  # it cannot beat the incumbent
        else:
            best, fewest = found, used
        if fewest <= bound:
            break
    return best or []


def report(fillings: list[tuple[Filling, int]], size: int = SIZE) -> tuple[int, int]:
    """Sequences that a plan uses, and the fewest that any plan could."""
    counts: dict[int, int] = {}
    for filling, times in fillings:
        for x, k in filling:
            counts[x] = counts.get(x, 0) + k * times
    return sum(times for _, times in fillings), least_sequences(counts, size)


def _slots(fillings: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows sorted by length and first rank. At most size * ln(size) fillings of at
    most sqrt(2 * size) lengths each, so under 330,000 rows for 1024, whatever the input."""
    rows, sequence, seen = [], 0, {}
    for filling, times in fillings:
        offset = 0
        for x, k in filling:
            rows.append((x, seen.get(x, 0), sequence, offset, k))
            seen[x] = seen.get(x, 0) + k * times
            offset += x * k
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {n: table[:, i].copy() for i, n in enumerate(("length", "first", "sequence", "offset", "k"))}


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null text is empty and gives its end id alone. A null doc_id stays null; repeated rows are packed each. An empty
    table gives an empty result; further columns are ignored. path: the vocabulary's ranks; end_id ends each document.
    """
    spark = docs.sparkSession
    made = keep(pieces(docs, size, end_id, path), "pieces")
    counted = made.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    sent = spark.sparkContext.broadcast(_slots(plan(histogram, size)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        keys = slots["length"] << 44 | slots["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            turn, k = rank - slots["first"][at], slots["k"][at]
            new = {"sequence_id": slots["sequence"][at] + turn // k, "offset": slots["offset"][at] + turn % k * length}
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(new[n], pa.int64()) if n in new else batch.column(n) for n in names], names=names)

    ranked = made.join(shifts, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(place, schema)
