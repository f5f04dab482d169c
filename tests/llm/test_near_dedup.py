import random
from itertools import combinations

import numpy as np
import pytest

from assayspark.llm import components as C
from assayspark.llm import near_dedup as N


def shingle_set(text, width):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x1c", "\x1d")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, width):
    sets = [shingle_set(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            top[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n, group):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(rnd.choice("aeioustr") for _ in range(3))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([1, 3, 8, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            copy = [w if rnd.random() > rnd.choice([0.0, 0.02, 0.06]) else word() for w in base]
            texts.append("\n".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    base = [word() for _ in range(100)]
    texts += [" ".join(w if rnd.random() > 0.05 else word() for w in base) for _ in range(group)]
    texts += [None, "", " \n", "ABC", "abc", "é É", "a b", "x " * 30000, "x " * 29999]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus(width, 60, 40)
    rows += [(None, rows[0][1]), (None, "only this"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, entry int").repartition(3)
    got = N.near_duplicates(docs, width=width, percent=80).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, width)
    groups = {}
    for r in got:
        if r.n_shingles:
            groups.setdefault(r.component_id, []).append(r)
        assert r.n_shingles or r.stays
    for top, members in groups.items():  # one text of each group stays
        stay = {(r.doc_id, r.text_hash) for r in members if r.stays}
        assert len(stay) == 1 and {d for d, _ in stay} == {top}


@pytest.mark.parametrize("listed", [0, 10**9])
def test_rest_in_blocks_and_in_pairs(spark, monkeypatch, listed):
    monkeypatch.setattr(N, "LEADERS", 1)
    monkeypatch.setattr(N, "LISTED", listed)
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = corpus(9, 10, 60)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 2)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_meet_up_to_the_distance(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, N.LONGS * 8, dtype=np.uint8)
    base[N.SYMBOLS :] = 0
    signs = [base]
    for _ in range(40):
        other = base.copy()
        other[rng.choice(N.SYMBOLS, N.MOST_DIFFERENCES, replace=False)] ^= 1
        signs.append(other)
    rows = [(i, *map(int, s.view("<i8"))) for i, s in enumerate(signs)]
    entries = spark.createDataFrame(rows, "entry long, " + ", ".join(f"s{i} long" for i in range(N.LONGS)))
    keys = N.chunk_keys(entries)
    mine = {r.key for r in keys.filter("entry = 0").collect()}
    assert {r.entry for r in keys.collect() if r.key in mine} == set(range(41))
    left, right = entries.alias("l"), entries.alias("r")
    far = left.join(right, N.F.expr("l.entry = 0 AND r.entry > 0")).select(N.differences("l", "r").alias("n")).collect()
    assert {r.n for r in far} == {N.MOST_DIFFERENCES}


def test_recall_of_the_search_at_the_least_similarity():
    """Pairs of sets of a similarity of exactly 0.8: all but about one in 10 ** 7 share a key and are let through."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (9, 45, 450) * 1500:
        both, own = n * 8 // 9, n // 9
        values = rng.integers(1 << 63, size=both + 2 * own, dtype=np.uint64)
        sets += [values[: both + own], np.concatenate([values[:both], values[both + own :]])]
    signs = N.signatures(sets)[:, : N.SYMBOLS]
    differ = signs[::2] != signs[1::2]
    meet = (differ.reshape(len(differ), -1, N.CHUNK).sum(2) <= 1).any(1) & (differ.sum(1) <= N.FAR)
    assert 0.19 < differ.mean() < 0.21 and meet.mean() > 0.9995


def test_components(spark):
    rnd = random.Random(8)
    nodes = rnd.sample(range(-1000, 1000), 300)
    links = [(nodes[i], nodes[i + 1]) for i in range(120)] + [(nodes[130], n) for n in nodes[131:200]] + [(nodes[250], nodes[251]), (7, 7)]
    rnd.shuffle(links)
    got = dict(C.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    want = {n: min(part) for part in (nodes[:121], nodes[130:200], nodes[250:252]) for n in part}
    assert got == want
