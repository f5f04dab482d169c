"""Toxic passages as maximum-scoring segments of token log-odds.

Learning. Labelled texts give each token (a word, or the first letters of words) its log-odds of standing in toxic
texts, with a Dirichlet prior: half a text for each token, and PRIOR texts in proportion to the token's share of all
texts. Log-odds that chance could give (the signed root of the likelihood ratio, which acts as a normal deviate, is below
LEAST_Z) count as 0; all others are the tokens' scores, below 0 for tokens of clean texts. Near copies of a text count once.

Search. A text is the sequence of its tokens' scores, each less a small DRIFT, so that by chance sums fall. One pass
(Ruzzo and Tompa) finds all maximal scoring segments in linear time.

Calibration. By the extreme-value law of segment scores, a text of m tokens has m exp(-l S) segments of score S or
more by chance, where l solves sum p exp(l s) = 1 over the scores in texts that are not toxic. Segments of which there
would be SIGNIFICANT or fewer are the passages. The best sum statistic over a text's segments is turned into a
probability by a logistic curve, fitted to labelled texts that the scores were not learnt from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import keep, map_rows

#: At most so many labelled rows are learnt from: those whose hashed doc_id is smallest.
LABELLED_ROWS = 40_000
PREFIXES = (4, 5, 6)
PRIOR = 10.0  # in texts
LEAST_Z = 5.0
DRIFT = 0.25
SIGNIFICANT = 0.01
THRESHOLD = 0.7
COUNTED = 400_000  # tokens that a task counts before it hands them on
BINS = 100  # scores to 1 are counted in so many steps
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

Segment = tuple[int, int, float]  # first and last token, score


def words(text: str) -> list[bytes]:
    """Runs of letters and digits; A-Z in lower case, characters beyond ASCII as they are."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def prefixes(word: bytes) -> list[bytes]:
    """The word's first letters as tokens of their own, marked by a `*`."""
    letters = word.decode(errors="replace")
    return [f"{letters[:n]}*".encode() for n in PREFIXES if n < len(letters)]


def segments(sums: np.ndarray, places: np.ndarray) -> list[Segment]:
    """All maximal scoring segments. sums: the running sums of all scores, with 0 before the first; places: of scores above 0.

    Each candidate is kept with the sums left of it and up to its end, and the last one before it that starts lower. A
    new score joins back over earlier candidates for as long as one starts lower and ends no higher than it does.
    """
    held: list[tuple[int, int, float, float, int]] = []
    for place, low, high in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist(), strict=True):
        first, j = place, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                break
            first, _, low, _, before = held[j]
            del held[j:]
            j = before
        held.append((first, place, low, high, j))
    return [(first, last, high - low) for first, last, low, high, _ in held]


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0  # l
    offset: float = -3.0
    slope: float = 0.0
    _seen: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": None}

    def seen(self) -> dict:
        """Word to score, less the drift; the word itself goes before its prefixes, of which the strongest counts."""
        if self._seen is None:
            scores = self.scores

            class Seen(dict):
                def __missing__(self, word: bytes) -> float:
                    if len(self) >= COUNTED:
                        self.clear()
                    value = scores.get(word)
                    if value is None:
                        value = max((scores[p] for p in prefixes(word) if p in scores), key=abs, default=0.0)
                    self[word] = value = value - DRIFT
                    return value

            self._seen = Seen()
        return self._seen

    def token_scores(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.seen().__getitem__, tokens), dtype=np.float64, count=len(tokens))

    def segments(self, tokens: list[bytes]) -> list[Segment]:
        scores = self.token_scores(tokens)
        places = np.flatnonzero(scores > 0)
        return segments(np.concatenate([[0.0], np.cumsum(scores)]), places) if len(places) else []

    def passages(self, n_tokens: int, found: list[Segment]) -> list[Segment]:
        """The significant segments: chance would give SIGNIFICANT of their score, or fewer, in the whole text."""
        least = math.log(max(1, n_tokens) / SIGNIFICANT)
        return [s for s in found if self.rate * s[2] >= least]

    def statistic(self, n_tokens: int, found: list[Segment]) -> float:
        """The best of the sum statistics over the r highest segments, for any r; without segments that of score 0."""
        chance, total, best = math.log(max(1, n_tokens)), 0.0, -math.inf
        for r, (_, _, score) in enumerate(sorted(found, key=lambda s: -s[2]), 1):
            total += self.rate * score
            best = max(best, total - r * chance + math.lgamma(r + 1))
        return max(best, -chance) if found else -chance

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.offset + self.slope * statistic))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and family (the least hash of the text's word pairs, which near copies share) of the rows to learn from; of a
    family, the text with the smallest doc_id."""
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    few = few.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)  # 12 bytes a row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")

    def work(rows: pa.RecordBatch) -> dict:
        out = []
        for text in rows.column("text").to_pylist():
            ws = words(text or "")
            out.append(min((xxhash.xxh3_64_intdigest(a + b" " + b) for a, b in zip(ws, ws[1:] or ws, strict=False)), default=0) >> 1)
        return {"doc_id": rows.column("doc_id"), "text": rows.column("text"), "toxic": rows.column("toxic"), "family": out}

    rows = map_rows(rows, "text", "doc_id long, text string, toxic int, family long", work)
    return rows.groupBy("family", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, toxic, clean: in how many of the task's texts of either kind it stands."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        tokens = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(tokens, pa.binary()), *(pa.array([counts[k][t] for t in tokens], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "toxic", "clean"])
        for c in counts:
            c.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            tokens = set(words(text or ""))
            counts[1 if toxic else 0].update(tokens | {p for t in tokens for p in prefixes(t)})
            if sum(map(len, counts)) > COUNTED:
                yield from out()
    yield from out()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that are not held out. Without toxic or other texts among them, all scores are low."""
    rows = keep(_labelled(docs, labels), "labelled")
    fit = rows.filter("family % 3 <> 0")
    size = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = float(size.get(1, 0)), float(size.get(0, 0))
    if not n_toxic or not n_clean:
        return Model()
    counts = fit.select("text", "toxic").mapInArrow(_token_counts, "token binary, toxic long, clean long")
    counts = counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    here, whole = F.col("toxic") + F.col("clean"), n_toxic + n_clean
    odds = []
    for c, n in (("toxic", n_toxic), ("clean", n_clean)):
        prior = 0.5 + PRIOR * here / whole
        odds.append(F.log((F.col(c) + prior) / (n + PRIOR + 1 - F.col(c) - prior + 1e-9)))
    surprise = sum(F.when(F.col(c) > 0, 2 * F.col(c) * F.log(F.col(c) / here / (n / whole))).otherwise(0.0) for c, n in (("toxic", n_toxic), ("clean", n_clean)))
    z, delta = F.sqrt(F.greatest(F.lit(0.0), surprise)), odds[0] - odds[1]
    scored = counts.filter(z >= LEAST_Z).select("token", delta.alias("score")).filter("score <> 0")
    model = Model({bytes(r["token"]): float(r["score"]) for r in scored.orderBy("token").collect()})
    if not any(s > DRIFT for s in model.scores.values()):
        return Model()

    tried = rows.filter("family % 3 = 0")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(np.rint(sent.value.token_scores(words(text or "")) * BINS).astype(int).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["bin", "n"])

    found = tried.filter("toxic = 0").select("text").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    model.rate = _rate({r["bin"] / BINS: r["n"] for r in found.collect()}, model)  # as many rows as scores have bins
    again = rows.sparkSession.sparkContext.broadcast(model)

    def statistics(rows: pa.RecordBatch) -> dict:
        tokens = [words(t or "") for t in rows.column("text").to_pylist()]
        return {"toxic": rows.column("toxic"), "x": [again.value.statistic(len(t), again.value.segments(t)) for t in tokens]}

    xy = sorted((r["x"], r["toxic"]) for r in map_rows(tried, "text", "toxic int, x double", statistics).collect())  # 12 bytes for each of a third of LABELLED_ROWS
    model.offset, model.slope = _logistic(np.array([x for x, _ in xy]), np.array([float(y) for _, y in xy]))
    return model


def _rate(counts: dict[float, int], model: Model) -> float:
    """l, by bisection, from how often each score stands in texts that are not toxic. They may hold no score above 0 at all, so
    one of the mean is added."""
    up = [s - DRIFT for s in model.scores.values() if s > DRIFT]
    scores, n = (np.array(x, dtype=np.float64) for x in zip(*sorted([*counts.items(), (float(np.mean(up)), 1), (-DRIFT, 1)]), strict=True))
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        total = (n * np.exp(np.minimum(middle * scores, 300))).sum() / n.sum()
        low, high = (middle, high) if total < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope by Newton's steps, the slope slightly shrunk and never negative."""
    if not len(x) or y.min() == y.max():
        return (-3.0, 0.5)
    center, spread = float(x.mean()), float(x.std()) or 1.0
    design, w = np.stack([np.ones_like(x), (x - center) / spread], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (y - p) - np.array([0, 0.05]) * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.05]), slope)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    b = max(0.0, w[1]) / spread
    return float(w[0] - b * center), float(b)


def score_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted and passages.

    score is the probability of the label 1; passages are the significant maximal scoring segments (first and last word
    from 0, and their score). A null or empty text has no passage and the score that goes with that. Rows with a null doc_id are
    scored and not held out; repeated rows are scored each. Labels that repeat are averaged, null labels are left out;
    without labels of both kinds all scores are below the threshold. An empty table gives an empty result; further
    columns are ignored. Only the texts enter a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def work(rows: pa.RecordBatch) -> dict:
        model = sent.value
        score, passages = [], []
        for text in rows.column("text").to_pylist():
            tokens = words(text or "")
            found = model.segments(tokens)
            score.append(model.probability(model.statistic(len(tokens), found)))
            passages.append([{"first": a, "last": b, "score": s} for a, b, s in model.passages(len(tokens), found)])
        return {"doc_id": rows.column("doc_id"), "score": score, "passages": passages}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_rows(rows, "text", "doc_id long, score double, passages array<struct<first:long,last:long,score:double>>", work)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not predicted as toxic; nothing is shuffled for it.

    Null and empty texts have the score of a text without segments. Repeated rows go or stay each; null doc_ids are as
    others; an empty table gives an empty result; further columns stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            good = []
            for text in batch.column("text").to_pylist():
                tokens = words(text or "")
                good.append(model.probability(model.statistic(len(tokens), model.segments(tokens))) < THRESHOLD)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
