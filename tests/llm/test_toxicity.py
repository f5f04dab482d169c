import math
import random
import time
import zlib

import numpy as np
import pytest

from assayspark.llm import toxicity as T


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then those left and right of it."""

    def parts(lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*parts(lo, i), (i, j - 1, best[0]), *parts(j, hi)]

    return parts(0, len(scores))


def test_segments_against_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([-1.0, -1.0, -0.6, -4.2, 0.7, 2.3, 3.1]) for _ in range(rnd.randrange(0, 16))]
        got = run_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in brute_segments(scores)])


def run_segments(scores):
    values = np.array(scores, dtype=float)
    return T.segments(np.concatenate([[0.0], np.cumsum(values)]), np.flatnonzero(values > 0))


def test_segments_take_linear_time():
    """Hits far apart, of which none joins another: the search for one that starts lower must not look through all."""
    times = []
    for n in (20_000, 80_000):
        scores = ([1.0] + [-0.25] * 40) * n
        start = time.process_time()
        assert len(run_segments(scores)) == n
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 0.5
    falling = [x for i in range(30_000) for x in (2.0, -2.0 - i % 3)]
    start = time.process_time()
    run_segments(falling)
    assert time.process_time() - start < 5


def test_model_scores_and_passages_against_a_plain_computation(spark):
    """Log-odds, their significance and the passages' expected numbers, computed anew from the texts that were learnt from."""
    docs, labels = corpus(700, 6)
    rows = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = T.learn(*rows)
    assert model == T.learn(rows[0].repartition(5), rows[1].repartition(3))  # whatever the partitions are
    learnt = [r for r in T._labelled(*rows).collect() if r.family % 3]
    n = [sum(r.toxic == k for r in learnt) for k in (0, 1)]
    for token, score in [(t, model.scores.get(t, 0.0)) for t in (b"badword", b"worse", b"vile*", b"a", b"ou")]:
        has = [sum(r.toxic == k and (token in T.words(r.text) or any(token in T.prefixes(w) for w in T.words(r.text))) for r in learnt) for k in (0, 1)]
        here, whole = sum(has), sum(n)
        prior = 0.5 + T.PRIOR * here / whole
        odds = [math.log((has[k] + prior) / (n[k] + T.PRIOR + 1 - has[k] - prior)) for k in (0, 1)]
        root = sum(2 * has[k] * math.log(has[k] / here / (n[k] / whole)) for k in (0, 1) if has[k]) if here else 0.0
        assert score == pytest.approx(odds[1] - odds[0] if math.sqrt(max(0, root)) >= T.LEAST_Z else 0.0, abs=1e-6), token
    tokens = T.words("quiet talk " * 50 + "badword worse badword " + "quiet talk " * 50)
    found = model.segments(tokens)
    assert [s[:2] for s in model.passages(len(tokens), found)] == [(100, 102)]
    assert all((len(tokens) * math.exp(-model.rate * s[2]) <= T.SIGNIFICANT) == (s in model.passages(len(tokens), found)) for s in found)


def corpus(n=900, seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.choice([2, 3, 4])))
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = [word() for _ in range(rnd.choice([20, 60, 200]))]
        for _ in range(rnd.randrange(1, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["badword", "WORSE,", "vile" + word() + word()]))
        docs.append((i, " ".join(words), "score"))
        labels.append((i, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int"


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "badword", "x"), (10_001, None, "x"), (10_002, "", "x"), (10_003, "worse " * 30000, "x"), docs[0], docs[0]]
    got = T.score_texts(spark.createDataFrame(docs + odd, DOCS).repartition(3), spark.createDataFrame([*labels, (3, None), labels[5]], LABELS)).collect()
    assert len(got) == len(docs) + len(odd)
    truth, right, held = dict(labels), 0, 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id in truth:
            held += 1
            right += r.predicted == truth[r.doc_id]
    assert right / held > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[10_003].predicted == 1 and by_id[10_001].predicted == 0
    assert by_id[10_001].score == by_id[10_002].score
    assert by_id[10_003].passages[0][:2] == (0, 29999)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(300)
    docs = spark.createDataFrame(docs, DOCS)
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (T.learn(docs, spark.createDataFrame(x, LABELS)) for x in (labels, other))
    assert a == b and a.scores


def test_no_labels_and_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a", "x")], DOCS), spark.createDataFrame([], LABELS)
    assert [r.predicted for r in T.score_texts(docs, none).collect()] == [0]
    assert [r.predicted for r in T.score_texts(docs, spark.createDataFrame([(1, 1), (2, 1)], LABELS)).collect()] == [0]
    assert T.score_texts(docs.limit(0), none).collect() == []
