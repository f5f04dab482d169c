import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.llm import class_lm as C
from assayspark.llm.shared import Scratch

SMALL = C.Sizes(words=6, known=12, endings=5, classes=4, rounds=4)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def made(rnd, n):
    """Texts of two kinds of words that don't mix, so that classes tell much."""
    kinds = [[f"{a}{b}" for a in x for b in ("", "é", "z", "zz", "Q", "-1")] for x in ("abCd", "éxyß")]
    return [(i, " ".join(rnd.choices(k, [1 / (1 + j) for j in range(len(k))], k=rnd.randrange(25)))) for i in range(n) for k in [rnd.choice(kinds)]]


def tables(docs):
    train = [words(t) for i, t in docs if not is_held_out(i)]
    counts = Counter(w for t in train for w in t)
    return train, counts, sorted(counts, key=lambda w: (-counts[w], w.encode()))


def brute(docs, sizes, classes):
    """All columns from the items' classes, by plain loops."""
    train, counts, ranked = tables(docs)
    ending = lambda w: zlib.crc32(w.encode()[-3:]) % sizes.endings
    own = {w: i for i, w in enumerate(ranked[: sizes.words], 1)}
    item = lambda w: 0 if w is None else own.get(w) or 1 + sizes.words + ending(w)
    tokens, n_all, v = Counter(), len(train) + sum(counts.values()), len(counts) + bool(train)
    links, into, out = Counter(), Counter(), Counter()
    for t in train:
        last = None
        for w in [*t, None]:
            a, b = classes[item(last)], classes[item(w)]
            links[a, b] += 1
            out[a] += 1
            into[b] += 1
            tokens[item(w)] += 1
            last = w
    e_tokens, e_words = Counter(), Counter()
    for w in ranked[sizes.words :]:
        e_tokens[ending(w)] += counts[w]
        e_words[ending(w)] += 1
    n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = (n1 + 0.5) / (n1 + 2 * n2 + 1)
    mass = Counter()
    for i in range(1 + sizes.words + sizes.endings):
        mass[classes[i]] += tokens[i] + 0.5 * (i > sizes.words)

    def step(a, w):
        b, i = classes[item(w)], item(w)
        share = (into[b] + 1) / (n_all + sizes.classes)
        p = (links[a, b] + C.MIXED * share) / (out[a] + C.MIXED) * (tokens[i] + 0.5 * (i > sizes.words)) / mass[b]
        if i > sizes.words and e_tokens[ending(w)]:
            p *= ((counts[w] - d) if counts[w] else d * e_words[ending(w)]) / e_tokens[ending(w)]
        return p

    rows = []
    for doc_id, text in docs:
        t, last, score = words(text), 0, 0.0
        for w in [*t, None]:
            score += math.log10(step(classes[last], w))
            last = item(w)
        base = sum(math.log10((counts[w] + 1) / (n_all + v + 1)) for w in t) + math.log10((len(train) + 1) / (n_all + v + 1))
        rows.append((doc_id, is_held_out(doc_id), len(t) + 1, sum(w in counts for w in t) + bool(train), n_all, base, score))
    return rows, step, ranked, ending


def frame(spark, docs):
    rows = [(i, t, 3, "x") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, row string").repartition(3)


def learnt(spark, docs, sizes):
    rows = frame(spark, docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "text")
    return C.learn(rows, sizes, Scratch(spark))[0]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_scores_against_brute_force(spark):
    rnd = random.Random(8)
    docs = [*made(rnd, 120), (None, "a b unseen"), (None, None), (7, ""), (7, " \t\n"), (2**40, "never seen WORDS at all a")]
    model = learnt(spark, docs, SMALL)
    want, step, ranked, ending = brute(docs, SMALL, model.classes)
    same(C.score_texts(frame(spark, docs), SMALL).collect(), want)
    assert model.classes[0] == 0 and 0 not in model.classes[1:]
    # what may follow a class sums to 1: the end, known words, and one unknown word for each ending
    unknown, n = {}, 0
    while len(unknown) < SMALL.endings:
        n += 1
        unknown.setdefault(ending(f"unknown{n}"), f"unknown{n}")
    bare = [w for e, w in unknown.items() if not any(ending(x) == e for x in ranked[SMALL.words :])]
    for a in range(SMALL.classes):
        seen = {e: w for e, w in unknown.items() if w not in bare}
        total = step(a, None) + sum(step(a, w) for w in ranked) + sum(step(a, w) for w in [*seen.values(), *bare])
        assert total == pytest.approx(1, abs=1e-9)


def test_each_move_is_the_best(spark):
    rng = np.random.default_rng(4)
    for _ in range(40):
        n_items, k = 12, 5
        pairs = rng.integers(0, 5, (n_items, n_items)) * (rng.random((n_items, n_items)) < 0.5)
        classes = np.concatenate([[0], rng.integers(1, k, n_items - 1)])

        def of(classes, k=k, pairs=pairs):
            out = np.zeros((k, k))
            np.add.at(out, (classes[:, None], classes[None, :]), pairs)
            return out

        state = C.Exchange(of(classes), classes)
        for item in range(1, n_items):
            a, b = np.flatnonzero(pairs[item]), np.flatnonzero(pairs[:, item])
            codes, n = np.concatenate([a, b + n_items]), np.concatenate([pairs[item][a], pairs[b, item]]).astype(float)
            tried = []
            for c in range(1, k):
                other = state.classes.copy()
                other[item] = c
                tried.append(C.likelihood(of(other)))
            state.move(item, codes, n)
            assert np.array_equal(state.links, of(state.classes))
            assert C.likelihood(state.links) == pytest.approx(max(tried), abs=1e-6)


def test_rounds_raise_the_likelihood_and_find_the_kinds(spark):
    docs = made(random.Random(9), 400)
    sizes = C.Sizes(words=30, known=40, endings=8, classes=3, rounds=6)
    rows = frame(spark, docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "text")
    model, _ = C.count(rows, sizes, Scratch(spark))
    classes, links, history = C.cluster(C._links(C._read(rows, model), model).cache(), sizes)
    assert max(history) > history[0] and C.likelihood(links) == max(history)
    kinds = [{classes[i] for w, i in model.numbers.items() if i <= 30 and (w[:1] in b"abcd") == first} for first in (True, False)]
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]


def test_odd_tables(spark):
    assert C.score_texts(frame(spark, [(1, "a")]).limit(0), SMALL).collect() == []
    out = [i for i in range(100) if is_held_out(i)][:2]
    got = C.score_texts(frame(spark, [(i, "a b") for i in out]), SMALL).collect()  # nothing to learn from
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)] * 2
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    docs = [(1, "same words"), (1, "same words"), (None, "same"), (3, "long word " * 100_000), (4, "y" * 500_000), (out[0], "y" * 500_000 + "q"), (out[1], "hot " * 50_000)]
    same(C.score_texts(frame(spark, docs), SMALL).collect(), brute(docs, SMALL, learnt(spark, docs, SMALL).classes)[0])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not there")
def test_held_out_texts_of_the_table(spark):
    """With production parameters but fewer words: texts that were not learnt from are likelier than by single words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = C.score_texts(docs, C.Sizes(words=2000, known=5000, endings=512, classes=32)).toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 10
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.2
