"""Language-model scores by a class-based bigram model, whose classes come from exchange clustering.

    P(w | v) = P(class of w | class of v) P(w | class of w)

Counts. Words of all training texts are counted, and so are all pairs of neighbours. The Sizes.words most frequent words
are clustered each by itself; every other word, known or not, by its ending (its last bytes, hashed to Sizes.endings
values), so each word has a class. How often each word stands in the texts is counted for all words, whatever their number.

Exchange. Each item (word or ending) goes to the class where the log-likelihood of the class bigrams is largest, given
the classes of all others. A round deals the items' links to tasks; a task moves its own items one after the other, seeing
its own moves and the counts of the round before for the rest. Class counts are summed anew after each round, rounds end when
the likelihood hardly grows, and the best round's classes count.

Smoothing. Class transitions are mixed with the classes' shares by a Dirichlet prior of MIXED tokens. A word within its ending
has its count less a discount D = n1 / (n1 + 2 n2); what is discounted goes to the ending's unknown words, which
count as one symbol for each ending. So the probabilities of what may follow sum to 1.

The counts of the Sizes.known most frequent words are sent to the tasks; all other words are joined to the table of counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import Scratch, slices

MIXED = 20.0
ENDING = 3  # bytes
COUNTED = 500_000  # words that a task counts before it hands them on
JOINED = 4_000_000  # tokens whose pairs a task counts before it hands them on
LEAST_GAIN = 2e-3  # of the log-likelihood, for another round
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Sizes:
    """words: clustered by themselves. known: whose counts are sent to the tasks. The rest bound the model, not the data."""

    words: int = 16_384
    known: int = 131_072
    endings: int = 4_096
    classes: int = 64
    rounds: int = 8


def tokens(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case; the end is not among them."""
    return (text or "").encode().translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """Numbers of words: 0 is the end, 1.. the known words by rank, then the endings of all others. Items: 0 the end, 1.. the
    clustered words, then endings."""

    sizes: Sizes
    numbers: dict[bytes, int]
    counts: np.ndarray  # of the end and the known words
    train_tokens: int
    train_words: int  # V
    discount: float
    ending_tokens: np.ndarray
    ending_words: np.ndarray
    classes: np.ndarray | None = None  # of items
    links: np.ndarray | None = None  # pairs of classes

    def items(self) -> np.ndarray:
        """The item of each number."""
        s = self.sizes
        out = np.arange(1 + s.known + s.endings, dtype=np.int64)
        out[1 + s.known :] += s.words - s.known
        out[1 + s.words : 1 + s.known] = 1 + s.words  # numbers that no word has, where there are fewer words
        for w, i in self.numbers.items():
            if i > s.words:
                out[i] = 1 + s.words + ending(w, s)
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class of each number; log10 of transitions, of each number's emission (for words that aren't known, without their own
        share of the ending), and of each number's base probability (for words that aren't known, without their own count)."""
        s, items = self.sizes, self.items()
        before, after = self.links.sum(axis=1), self.links.sum(axis=0)
        share = (after + 1) / (after.sum() + s.classes)
        moves = np.log10((self.links + MIXED * share[None, :]) / (before + MIXED)[:, None])
        # tokens of items; endings have half a token more, so that none is impossible
        of_items = np.zeros(1 + s.words + s.endings)
        of_items[: min(len(self.counts), 1 + s.words)] = self.counts[: 1 + s.words]
        of_items[0] = max(of_items[0], 1.0)  # the end is all of its class
        of_items[1 + s.words :] = self.ending_tokens + 0.5
        whole = np.bincount(self.classes, of_items, s.classes)
        with np.errstate(divide="ignore"):
            of_items = np.log10(of_items) - np.log10(whole[self.classes])
        emits, within = of_items[items], np.log10(np.maximum(self.ending_tokens, 1))
        base = np.full(len(items), -math.log10(self.train_tokens + self.train_words + 1))
        base[: len(self.counts)] += np.log10(self.counts + 1)
        emits[1 + s.known :] -= within
        rest = np.arange(1 + s.words, len(self.counts))
        if len(rest):
            emits[rest] += np.log10(self.counts[rest] - self.discount) - within[items[rest] - 1 - s.words]
        return self.classes[items], moves, emits, base

    def unknown(self) -> np.ndarray:
        """log10 of what unknown words have of each ending, before it is divided by the ending's tokens."""
        return np.where(self.ending_tokens > 0, np.log10(np.maximum(self.discount * self.ending_words, 1e-300)), 0.0)


def ending(word: bytes, sizes: Sizes) -> int:
    return zlib.crc32(word[-ENDING:]) % sizes.endings


def _ending(word: Column, sizes: Sizes) -> Column:
    return (F.crc32(F.substring(word.cast("binary"), -ENDING, ENDING)) % sizes.endings).cast("int")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()

    get = counts.get
    for batch in batches:
        for rows in slices(batch, "text"):
            for text in rows.column("text").to_pylist():
                for w in tokens(text):
                    counts[w] = get(w, 0) + 1
                if len(counts) >= COUNTED:
                    yield from out()
    yield from out()


def _after(last: tuple[int, str] | None) -> Column:
    """Of the counts: those that stand after `last` when ordered by count, then word."""
    c, word = last or (0, "")
    return (F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > word)) if last else F.lit(False)


def count(docs: DataFrame, sizes: Sizes, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model without classes, and word and c of all words beyond the known ones."""
    train = docs.filter("NOT held_out").select("text")
    counts = train.mapInArrow(_word_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = scratch.keep(counts, "counts")
    n_docs = train.count()
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    known = counts.orderBy(F.desc("c"), "word").limit(sizes.known).toArrow().to_pylist()  # bounded by Sizes.known
    known.sort(key=lambda r: (-r["c"], r["word"].encode()))
    last = [(known[n - 1]["c"], known[n - 1]["word"]) if len(known) >= n else None for n in (sizes.words, sizes.known)]
    ends = counts.filter(_after(last[0])).groupBy(_ending(F.col("word"), sizes).alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    ending_tokens, ending_words = np.zeros(sizes.endings), np.zeros(sizes.endings)
    for r in ends.collect():  # bounded by Sizes.endings
        ending_tokens[r["e"]], ending_words[r["e"]] = r["n"], r["v"]
    discount = (total["n1"] + 0.5) / (total["n1"] + 2 * total["n2"] + 1)
    model = Model(
        sizes, {r["word"].encode(): i for i, r in enumerate(known, 1)}, np.array([n_docs, *(r["c"] for r in known)], dtype=np.float64),
        total["n"] + n_docs, total["v"] + bool(n_docs), discount, ending_tokens, ending_words,
    )
    return model, counts.filter(_after(last[1]))


def _read(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, ids (numbers of the words and the end) and rare (the words that are not known, in order)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.numbers, model.sizes))
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.list_(pa.int32())), ("rare", pa.list_(pa.string()))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sizes = sent.value

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                return 1 + sizes.known + ending(word, sizes)

        number = Numbers(numbers).__getitem__
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, rare, ends, rare_ends = [], [], [0], [0]
                for text in rows.column("text").to_pylist():
                    words = tokens(text)
                    own = np.fromiter(map(number, words), np.int32, len(words))
                    rare += [words[i] for i in np.flatnonzero(own > sizes.known).tolist()]
                    ids += [own, np.zeros(1, np.int32)]
                    ends.append(ends[-1] + len(words) + 1)
                    rare_ends.append(len(rare))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), values) for at, values in ((ends, pa.array(np.concatenate(ids))), (rare_ends, pa.array(rare, pa.binary()).cast(pa.string())))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "doc_id", "held_out")), *lists], schema=pa.schema(fields))

    return docs.mapInArrow(read, "row long, doc_id long, held_out boolean, ids array<int>, rare array<string>")


def _links(read: DataFrame, model: Model) -> DataFrame:
    """item and links (code, n) of each item: codes below the number of items are items after it, others those before it."""
    sent, n_items = read.sparkSession.sparkContext.broadcast(model.items().astype(np.int64)), 1 + model.sizes.words + model.sizes.endings

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held, size = sent.value, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                run = np.concatenate([[0], *held])  # every text ends with 0, the start of the next
                codes, n = np.unique(run[:-1] * n_items + run[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((codes // n_items).astype(np.int32)), pa.array((codes % n_items).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])
                held.clear()

        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy()
            held.append(items[ids])
            size += len(ids)
            if size >= JOINED:
                yield from out()
                size = 0
        yield from out()

    counted = read.filter("NOT held_out").select("ids").mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = F.explode(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("code"), "n"), F.struct(F.col("b").alias("item"), (F.col("a") + n_items).alias("code"), "n")))
    return counted.select(both.alias("x")).select("x.*").groupBy("item").agg(F.collect_list(F.struct("code", "n")).alias("links"))  # at most 2 for each item


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    links = batch.column("links")
    flat, ends = links.flatten(), np.concatenate([[0], np.cumsum(np.diff(links.offsets.to_numpy()))])
    codes, n = flat.field("code").to_numpy(), flat.field("n").to_numpy().astype(np.float64)
    for i, item in enumerate(batch.column("item").to_pylist()):
        yield item, codes[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]


def _phi(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(links: np.ndarray) -> float:
    """The part of the log-likelihood that the classes decide."""
    return float(_phi(links).sum() - _phi(links.sum(axis=1)).sum() - _phi(links.sum(axis=0)).sum())


class Exchange:
    """Counts of class pairs, and the moves that a task makes."""

    def __init__(self, links: np.ndarray, classes: np.ndarray):
        self.links, self.classes = links.astype(np.float64), classes.copy()
        self.before, self.after, self.phi = self.links.sum(axis=1), self.links.sum(axis=0), _phi(self.links)

    def _shift(self, c: int, after: np.ndarray, before: np.ndarray, itself: float, sign: int) -> None:
        self.links[c] += sign * after
        self.links[:, c] += sign * before
        self.links[c, c] += sign * itself
        self.before[c] += sign * (after.sum() + itself)
        self.after[c] += sign * (before.sum() + itself)
        self.phi[c], self.phi[:, c] = _phi(self.links[c]), _phi(self.links[:, c])

    def move(self, item: int, codes: np.ndarray, n: np.ndarray) -> int:
        """The best class of the item, which goes there; class 0 is the end's alone."""
        k, n_items = len(self.links), len(self.classes)
        own = (codes == item) & (codes < n_items)
        itself, other = float(n[own].sum()), (codes != item) & (codes != item + n_items)
        right, of = codes < n_items, self.classes[codes % n_items]
        after = np.bincount(of[other & right], n[other & right], k)
        before = np.bincount(of[other & ~right], n[other & ~right], k)
        was = self.classes[item]
        self._shift(was, after, before, itself, -1)
        a, b = np.flatnonzero(after), np.flatnonzero(before)
        gain = (_phi(self.links[:, a] + after[a]) - self.phi[:, a]).sum(axis=1) + (_phi(self.links[b] + before[b][:, None]) - self.phi[b]).sum(axis=0)
        cell = np.diagonal(self.links)  # a class's pairs with itself get both parts and the item's own
        gain += _phi(cell + after + before + itself) + _phi(cell) - _phi(cell + after) - _phi(cell + before)
        out, into = after.sum() + itself, before.sum() + itself
        gain -= _phi(self.before + out) - _phi(self.before) + _phi(self.after + into) - _phi(self.after)
        gain[0] = -np.inf
        best = int(gain.argmax()) if gain.max() > gain[was] + 1e-9 else int(was)
        self._shift(best, after, before, itself, 1)
        self.classes[item] = best
        return best


def _class_links(profiles: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    sent = profiles.sparkSession.sparkContext.broadcast(classes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = sent.value, np.zeros(k * k)
        for batch in batches:
            for item, codes, n in _each(batch):
                right = codes < len(classes)
                total[classes[item] * k : classes[item] * k + k] += np.bincount(classes[codes[right]], n[right], k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["code", "n"])

    out = np.zeros(k * k)
    for r in profiles.mapInArrow(summed, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # k * k rows
        out[r["code"]] = r["n"]
    return out.reshape(k, k)


def cluster(profiles: DataFrame, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all items, counts of class pairs, and the log-likelihood of each round."""
    k, n_items = sizes.classes, 1 + sizes.words + sizes.endings
    classes = np.arange(-1, n_items - 1) % (k - 1) + 1
    classes[0] = 0
    links = _class_links(profiles, classes, k)
    history, best = [likelihood(links)], (classes, links)
    for _ in range(sizes.rounds):
        sent = profiles.sparkSession.sparkContext.broadcast((classes, links))

        def moved(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state = Exchange(sent.value[1], sent.value[0])
            for batch in batches:
                done = [(item, state.move(item, codes, n)) for item, codes, n in _each(batch) if item]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int32())], names=["item", "class"])

        classes = classes.copy()
        for r in profiles.mapInArrow(moved, "item int, class int").collect():  # as many as items
            classes[r["item"]] = r["class"]
        links = _class_links(profiles, classes, k)
        history.append(likelihood(links))
        if history[-1] > max(history[:-1]):
            best = (classes, links)
        if history[-1] < history[-2] + LEAST_GAIN * abs(history[-2]):
            break
    return (*best, history)


def _scored(read: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, n_tokens, and of the known words and ends: n_known, base_score, score."""
    sent = read.sparkSession.sparkContext.broadcast((model.tables(), len(model.counts), bool(model.counts[0]), model.sizes.known))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (classes, moves, emits, base), n_counts, end_known, known = sent.value
        for batch in batches:
            lists = batch.column("ids")
            ids, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            if not len(ids):
                continue
            starts, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), classes[ids]
            own = moves[np.concatenate([[0], of[:-1]]), of] + emits[ids]
            is_known = (ids < n_counts) & ((ids > 0) | end_known)
            sums = [np.add.reduceat(x, starts) for x in (is_known.astype(np.int64), base[ids], own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), pa.array(sizes.astype(np.int64)), *map(pa.array, sums)], schema=schema)

    return read.select("row", "doc_id", "held_out", "ids").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def learn(docs: DataFrame, sizes: Sizes, scratch: Scratch) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the counts of the words that are not known, and the texts as numbers."""
    model, rare = count(docs, sizes, scratch)
    read = scratch.keep(_read(docs, model), "read")
    profiles = scratch.keep(_links(read, model), "profiles")
    model.classes, model.links, _ = cluster(profiles, sizes)
    return model, rare, read


def score_texts(docs: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts that are not held out are learnt from, repeated rows each; a null doc_id is not held out. A null or empty text is its
    end alone. base_score is that of single words with one added to each count; score is the log10 of the class model's probability
    of the whole text. Without training texts every word is unknown, and train_tokens is 0. An empty table gives an empty result;
    further columns are ignored. Texts are read whole, whatever their length.
    """
    sizes, spark = sizes or Sizes(), docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model, rare, read = learn(docs, sizes, scratch)
    # of words that aren't known: the share of the ending, and the count, by a join that the words' own counts split
    ends = spark.createDataFrame([(i, x) for i, x in enumerate(model.unknown().tolist())], "e int, unknown double")  # Sizes.endings rows
    words = read.select("row", F.explode("rare").alias("word")).join(rare, "word", "left")
    words = words.withColumn("e", _ending(F.col("word"), sizes)).join(F.broadcast(ends), "e")
    rest = words.groupBy("row").agg(
        F.count("c").alias("known_too"), F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1)).alias("base_too"),
        F.sum(F.when(F.col("c").isNull(), F.col("unknown")).otherwise(F.log10(F.col("c") - model.discount))).alias("score_too"),
    )
    out = _scored(read, model).join(rest, "row", "left").fillna(0, ["known_too", "base_too", "score_too"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known_too")).alias("n_known"), F.lit(int(model.train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("base_too")).alias("base_score"), (F.col("score") + F.col("score_too")).alias("score"),
    )
