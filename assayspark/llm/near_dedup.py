"""Near duplicates: b-bit MinHash signatures joined by multi-index Hamming search, confirmed on whole sets.

A text's set is that of its word shingles. Its signature has 60 symbols of 8 bits: the low bits of the least hash of
the set under 60 hash functions. Two sets of similarity s differ in about 60 (1 - s) symbols.

* Pigeonhole. A signature is split into 12 chunks of 5 symbols. Two signatures that differ in at most 23 symbols have
  a chunk with at most one difference. Each chunk is entered under the 5 keys that leave out one of its symbols, which
  covers that one allowed error at every place, so all pairs up to distance 23 meet under some key, and of those at
  greater distances all that have such a chunk. Pairs that meet are let through up to distance 34. At a similarity of
  exactly 0.8, symbols differ with a probability of 0.2: a pair has no such chunk with 0.263 ** 12 = 1e-7, and differs in
  more than 34 symbols with less than 1e-9, and of less the more similar it is. The tests measure that.
* Copies (sets with equal hashes of 128 bits) are one entry. A key's entries are not paired with each other, which would grow with the square
  of a group: each is first paired with the few leaders of its key only. What is confirmed is joined into components,
  and only keys that still hold several components go on. Their entries outside the key's largest component are
  compared with all that they could still be linked to, in blocks that give back links only. A pair inside a component
  would change nothing. What is dealt out by such a component is dealt out by a salt too, so a large family of near
  copies is no single task's.
* Candidates within the distance are confirmed by the sizes of the intersection and union of their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.llm.components import components
from assayspark.llm.shared import Scratch, map_rows, slices

SYMBOLS, CHUNK = 60, 5  # of 8 bits each
#: Up to so many differences all pairs meet; up to so many, pairs that meet are confirmed.
MOST_DIFFERENCES, FAR = 2 * SYMBOLS // CHUNK - 1, 34
LONGS = (SYMBOLS + 7) // 8
LEADERS = 3
#: Pairs of a hub that are listed as rows; with more, blocks of about so many entries and shingles are compared.
LISTED, BLOCK, BLOCK_SHINGLES = 64, 500, 1_000_000
#: Parts that the entries of one hub are dealt out to.
SALTS = 32
#: Rows of a side that is sent to all executors (40 bytes each).
SENT_ROWS = 500_000
KEPT_WORDS = 300_000
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1 << 62, size=SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY_FACTORS = _rng.integers(1 << 62, size=CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words; as many as KEPT_WORDS are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int, words: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: width words each, or all words where there are fewer."""
    hashes = np.fromiter(map(words.__getitem__, text.encode("utf-8", "surrogatepass").lower().split()), dtype=np.uint64)
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    out = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS bytes for each set, none of them empty."""
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), LONGS * 8), dtype=np.uint8)
    for i, factor in enumerate(FACTORS):
        out[:, i] = _mix(np.minimum.reduceat(joined * factor, starts)).astype(np.uint8)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (128 bits of the whole set, null if empty) and the signature s0, s1, ..."""
    words = _Words()
    schema = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, " + ", ".join(f"s{i} long" for i in range(LONGS))

    def work(rows: pa.RecordBatch) -> dict:
        sets = [shingles(t or "", width, words) for t in rows.column("text").to_pylist()]
        filled = [s for s in sets if len(s)]
        signs = np.zeros((len(sets), LONGS), dtype=np.int64)
        if filled:
            signs[[i for i, s in enumerate(sets) if len(s)]] = signatures(filled).view("<i8")
        names = [set_hash(s) if len(s) else (None, None) for s in sets]
        return {
            "doc_id": rows.column("doc_id"),
            "text_hash": rows.column("text_hash"),
            "n_shingles": [len(s) for s in sets],
            "set_a": [a for a, _ in names],
            "set_b": [b for _, b in names],
        } | {f"s{i}": signs[:, i] for i in range(LONGS)}

    return map_rows(_texts(docs), "text", schema, work)


def set_hash(shingle_set: np.ndarray) -> tuple[int, int]:
    high, low = divmod(xxhash.xxh3_128_intdigest(shingle_set.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def chunk_keys(entries: DataFrame) -> DataFrame:
    """key and entry: each chunk of a signature with each one of its symbols left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                rows = batch.slice(at, 5000)
                signs = np.stack([rows.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(LONGS)], axis=1).view(np.uint8)[:, :SYMBOLS]
                terms = (signs.reshape(-1, SYMBOLS // CHUNK, CHUNK).astype(np.uint64) + np.uint64(1)) * KEY_FACTORS
                terms = _mix(terms)
                which = np.arange(SYMBOLS, dtype=np.uint64).reshape(1, SYMBOLS // CHUNK, CHUNK)
                keys = _mix(terms.sum(axis=2, keepdims=True) - terms + (which + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(rows.column("entry").to_numpy(), SYMBOLS))], names=["key", "entry"])

    return entries.select("entry", *(f"s{i}" for i in range(LONGS))).mapInArrow(work, "key long, entry long")


def differences(left: str, right: str) -> Column:
    """Symbols in which two signatures differ."""
    total = []
    for i in range(LONGS):
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        total.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return sum(total[1:], total[0])


class _Search:
    """What all rounds share: the entries, their keys and the whole sets of entries that are compared."""

    def __init__(self, docs: DataFrame, entries: DataFrame, width: int, percent: int, scratch: Scratch):
        self.docs, self.entries, self.width, self.percent, self.scratch = docs, entries, width, percent, scratch

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures and sizes allow the similarity."""
        left, right = (self.entries.select(F.col("entry").alias(c), F.struct("n_shingles", *(f"s{i}" for i in range(LONGS))).alias(f"sign_{c}")) for c in "ab")
        small, large = F.least("sign_a.n_shingles", "sign_b.n_shingles"), F.greatest("sign_a.n_shingles", "sign_b.n_shingles")
        near = (differences("sign_a", "sign_b") <= FAR) & (small * 100 >= large * self.percent)
        return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """entry and set, the whole sorted set of shingle hashes, of the entries in wanted(entry)."""
        columns = ["entry", "set_a", "set_b", "doc_id", "text_hash"]
        wanted = self.scratch.keep(wanted.distinct().join(self.entries, "entry").select(*columns), f"wanted-{name}")
        find = wanted.withColumnsRenamed({"doc_id": "want_id", "text_hash": "want_hash"})
        if wanted.count() <= SENT_ROWS:
            find = F.broadcast(find)
        words, width = _Words(), self.width

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, "text"):
                    named = zip(*(rows.column(c).to_pylist() for c in ("entry", "set_a", "set_b", "text")), strict=True)
                    found = [(e, s) for e, a, b, t in named if set_hash(s := shingles(t or "", width, words)) == (a, b)]
                    flat = np.concatenate([s for _, s in found]) if found else np.zeros(0, dtype=np.uint64)
                    sets = pa.ListArray.from_arrays(np.cumsum([0, *(len(s) for _, s in found)], dtype=np.int32), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.int64()), sets], names=["entry", "set"])

        texts = _texts(self.docs)
        texts = texts.join(find, (texts.text_hash == find.want_hash) & texts.doc_id.eqNullSafe(find.want_id)).select("entry", "set_a", "set_b", "text")
        return self.scratch.keep(texts.mapInArrow(whole, "entry long, set array<long>").dropDuplicates(["entry"]), f"sets-{name}")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """The close pairs whose whole sets are similar enough."""
        pairs = self.scratch.keep(self.close(pairs), f"pairs-{name}")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("entry")), name)
        left, right = (sets.select(F.col("entry").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return pairs.join(left, "a").join(right, "b").filter(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * self.percent).select("a", "b")

    def rest(self, still: DataFrame, found: DataFrame) -> DataFrame:
        """Links between components that share a key: all that are missing to join them.

        Of each key, the component with most entries there is the hub, and all other entries are attached to it. Any
        two entries of the key are then within the hub or attached to it, so comparing the attached entries with the
        hub's and with each other leaves out no pair. Where that is a few pairs they are listed; else both sides are
        cut into blocks, and each pair of blocks is compared in a task that gives back links only.
        """
        counts = still.groupBy("key", "component").agg(F.count("*").alias("n"))
        hubs = counts.groupBy("key").agg(F.max(F.struct("n", "component")).component.alias("hub"))
        sizes = self.entries.select("entry", "n_shingles")
        attached = still.join(hubs, "key").filter("component <> hub").select("hub", "entry", "component").distinct()
        attached = self.scratch.keep(attached.join(sizes, "entry"), "attached")
        few = attached.groupBy("hub").agg(F.count("*").alias("q"), F.sum("n_shingles").alias("q_shingles"))
        inside = _spread(found.select(F.col("component").alias("hub"), F.col("node").alias("entry")), few.select("hub"))
        alone = few.join(found.select(F.col("component").alias("hub")).distinct(), "hub", "left_anti").select("hub", F.col("hub").alias("entry"))
        inside = inside.unionByName(alone).withColumn("component", F.col("hub")).join(sizes, "entry")
        side = self.scratch.keep(inside.unionByName(attached), "side")
        few = self.scratch.keep(few.join(side.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("m_shingles")), "hub"), "few")
        small = F.col("q") * F.col("m") <= LISTED

        left, right = (_spread(x, few.filter(small).select("hub")) for x in (attached, side))
        left = left.select("hub", F.col("entry").alias("x"), F.col("component").alias("component_x"))
        pairs = left.join(right, "hub").filter("component <> component_x").select(F.least("x", "entry").alias("a"), F.greatest("x", "entry").alias("b")).distinct()
        links = self.confirmed(pairs, "rest")

        parts = lambda n: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(f"{n}_shingles") / BLOCK_SHINGLES))
        cells = few.filter(~small).select("hub", parts("m").alias("blocks"), parts("q").alias("lines"))
        all_blocks, all_lines = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("blocks", "lines"))
        place = lambda n: F.pmod(F.xxhash64("entry", F.lit(n)), F.col(n))
        members = _spread(side, cells).select("hub", "entry", "component", place("blocks").alias("block"), all_lines.alias("line"))
        asking = _spread(attached, cells).select("hub", "entry", "component", all_blocks.alias("block"), place("lines").alias("line"))
        sets = self.sets(members.select("entry"), "blocks")
        names = ("hub", "block", "line", "entry", "component", "set")  # anew on either side, as both come from the same tables
        members, asking = (x.join(sets, "entry").select(*(F.col(n).alias(n) for n in names)).groupBy("hub", "block", "line") for x in (members, asking))
        percent = self.percent
        return links.unionByName(members.cogroup(asking).applyInPandas(lambda m, q: _compared(m, q, percent), "a long, b long"))


def _spread(many: DataFrame, one: DataFrame) -> DataFrame:
    """many(hub, entry, ...) with the columns of one, which has a row for each of some hubs. A hub's entries are dealt out to SALTS
    parts, and its row goes to each of them."""
    salted = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")  # not sent: it grows with the hubs
    return many.withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(SALTS)).cast("int")).join(salted, ["hub", "salt"]).drop("salt")


def _compared(members: pd.DataFrame, asking: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each asking entry and each other component, one link to a member that is similar enough, if there is one."""
    out: list[tuple[int, int]] = []
    if len(members) and len(asking):
        sizes = members["set"].map(len).to_numpy()
        flat, ends = np.concatenate(members["set"].to_list()), np.cumsum(sizes)
        names, flat = np.unique(flat, return_inverse=True)
        starts, components, entries = ends - sizes, members["component"].to_numpy(), members["entry"].to_numpy()
        for x, component, own in zip(asking["entry"], asking["component"], asking["set"], strict=True):
            flags = np.zeros(len(names), dtype=np.int64)
            at = np.searchsorted(names, own)
            at = at[at < len(names)]
            at = at[np.isin(names[at], own)]
            flags[at] = 1
            both = np.add.reduceat(flags[flat], starts)
            near = (100 * both >= percent * (sizes + len(own) - both)) & (components != component)
            for c in np.unique(components[near]):
                y = entries[near & (components == c)][0]
                out.append((min(x, y), max(x, y)))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _open_keys(keys: DataFrame) -> DataFrame:
    """keys(key, entry) that several entries share, with leaders: the entries that stand first in LEADERS shuffled orders."""
    first = F.array(*(F.min_by("entry", F.xxhash64("entry", F.lit(i))) for i in range(LEADERS)))
    several = keys.groupBy("key").agg(F.min("entry").alias("low"), F.max("entry").alias("high"), first.alias("leaders")).filter("low < high")
    return keys.join(several.select("key", F.array_distinct("leaders").alias("leaders")), "key")


def _still_open(keys: DataFrame, found: DataFrame) -> DataFrame:
    """key, entry and component of the keys that hold several components."""
    keys = keys.join(found, keys.entry == found.node, "left").select("key", "entry", F.coalesce("component", "entry").alias("component"))
    several = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return keys.join(several, "key")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) and stays.

    Texts are linked when 100 * intersection >= percent * union of their sets of shingles of `width` words (A-Z in lower
    case; words are parted by space and U+0009 to U+000D). component_id is the smallest doc_id that links lead to, a
    document's own included; kept says that it is the document's own. stays names one text of each component: that of
    the smallest doc_id, and of several with that doc_id the one with the smallest text_hash. A null or empty text, or
    one without words, has an empty set, no links and its own doc_id, and stays; a text of fewer words has one shingle.
    Null doc_ids count after all others: a component of nothing else has a null component_id, and its rows are kept.
    Repeated rows are linked with each other and are all kept, and stay, if one is. An empty table gives an empty
    result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.keep(sketches(docs, width), "sketches")
    filled = sketched.filter("set_a IS NOT NULL")
    signs = [f"s{i}" for i in range(LONGS)]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    entries = filled.groupBy("set_a", "set_b").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"), *(F.first(s).alias(s) for s in signs))
    # numbers of entries hold from here on, as the table is written
    entries = scratch.keep(entries.select(F.monotonically_increasing_id().alias("entry"), "set_a", "set_b", "first", "first.doc_id", "first.text_hash", "n_shingles", *signs), "entries")
    search = _Search(docs, entries, width, percent, scratch)

    keys = scratch.keep(chunk_keys(entries), "all-keys")
    keys = scratch.keep(_open_keys(keys), "keys")
    pairs = keys.select("entry", F.explode("leaders").alias("leader")).filter("entry <> leader").select(F.least("entry", "leader").alias("a"), F.greatest("entry", "leader").alias("b")).distinct()
    links = scratch.keep(search.confirmed(pairs, "leaders"), "links")
    scratch.drop("all-keys", "pairs-leaders", "wanted-leaders", "sets-leaders")
    found = scratch.keep(components(links), "components")
    still = scratch.keep(_still_open(keys.select("key", "entry"), found), "open")
    more = scratch.keep(search.rest(still, found), "more")
    scratch.drop("keys", "open", "attached", "side", "few", *(f"{n}-{k}" for n in ("wanted", "sets") for k in ("rest", "blocks")), "pairs-rest")
    found = scratch.keep(components(links.unionByName(more)), "all-components")
    scratch.drop("links", "more", "components")
    least = entries.select("entry", "first").join(found, F.col("entry") == F.col("node"))
    names = least.groupBy("component").agg(F.min("first").alias("top"))
    named = found.join(names, "component").select(F.col("node").alias("entry"), "top")
    own = entries.join(named, "entry", "left").select("set_a", "set_b", F.coalesce("top", "first").alias("top"))
    out = filled.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(own, ["set_a", "set_b"])
    stays = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash"))
    out = out.select("doc_id", "n_shingles", F.col("top.doc_id").alias("component_id"), "text_hash", stays.alias("stays"))
    empty = sketched.filter("set_a IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("stays"))
    return out.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "stays")
