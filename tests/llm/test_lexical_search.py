import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assayspark.llm import lexical_search as S


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, first):
    docs = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = {w for i, t in items if i == item for w in words(t)}
        scored = []
        for doc_id, c in docs:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in wanted if c[w])
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(scored[:first], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, first=S.FIRST, parts=3):
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, score int").repartition(parts)
    queries = spark.createDataFrame([(*d, 7) for d in items], "item_id long, text string, doc_id long")
    got = sorted(map(tuple, S.search(rows, queries, first).collect()), key=str)
    assert got == brute(docs, items, first)
    return got


def made(rnd, n):
    vocabulary = [f"{a}{b}{c}" for a in "abÉк9" for b in "xyZ" for c in ("", "q", "ß", "0", "-")]
    odds = [1 / (1 + i) for i in range(len(vocabulary))]
    return [(rnd.randrange(n), " ".join(rnd.choices(vocabulary, odds, k=rnd.randrange(40)))) for _ in range(n)]


def test_random(spark):
    rnd = random.Random(5)
    docs = [*made(rnd, 400), (None, "ax ax"), (None, None), (3, ""), (4, "..."), (None, "ax ax")]
    items = [*((i % 9, t) for i, (_, t) in enumerate(made(rnd, 12))), (None, "ax AX byq"), (50, None), (51, "nowhere"), (52, "ax nowhere")]
    assert len(check(spark, docs, items)) > 300


def test_ties_copies_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POSTINGS", 20)
    docs = [(i, "same words here") for i in range(200)] + [(i, f"other text {i}") for i in range(300)]
    got = check(spark, docs, [(1, "same"), (2, "other same"), (3, "299")], parts=4)
    assert [g[2] for g in sorted(got, key=lambda g: g[1]) if g[0] == 1] == list(range(50))


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TERMS", 6)
    rnd = random.Random(6)
    check(spark, made(rnd, 60), [(i, t) for i, (_, t) in enumerate(made(rnd, 5))], first=3)


@pytest.mark.parametrize("run", [1, 7, 512])
def test_pivots_skip_and_lose_nothing(monkeypatch, run):
    """Heaps are those of whole scoring, with runs of any length; documents that can't beat the threshold are not looked at."""
    monkeypatch.setattr(S, "RUN", run)
    rng = np.random.default_rng(run)
    looked = []
    for _ in range(60):
        n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 60))
        lists = []
        for t in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < 0.9 / (1 + t * t))
            lists.append((docs, rng.integers(0, 40 * (1 + 3 * t), len(docs))))
        starts = np.concatenate([[0], np.cumsum([len(d) for d, _ in lists])])
        shard = S.Shard(list(range(n)), np.concatenate([d for d, _ in lists]), np.concatenate([x for _, x in lists]), starts)
        whole = np.zeros(n, dtype=np.int64)
        for d, x in lists:
            whole[d] += x
        want = [i for i in np.lexsort((np.arange(n), -whole)).tolist() if whole[i] > 0][:k]
        places, scores = shard.best(np.arange(len(lists)), k)
        got = sorted(zip(places.tolist(), scores.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]
        assert got == [(i, whole[i]) for i in want]
        looked.append(len(got))
    assert max(looked) > 20


def test_long_texts_and_empty_tables(spark):
    check(spark, [(1, "long word " * 100_000), (2, "x" * 500_000 + " long"), (3, "word")], [(1, "long word"), (2, "x" * 500_000)])
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert S.search(d, i).collect() == []
    assert S.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
