import hashlib
import random

from assayspark.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, digest string"  # `digest` clashes with a column of the operator


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for h, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], best[2], len(members), m == best, h) for m in members]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(1, "a b", "x"), (2, "ab", "x"), (3, "a\u00a0b", None), (4, None, "x"), (5, "", "x"), (6, " \n", "x"), (None, "a  b", "x"), (7, "a b c", "x"), (8, "é\tb" * 20000, "x"), (9, "é b" * 20000, "x"), (7, "a b c", "x")]
    got = X.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_random_groups(spark):
    rnd = random.Random(5)
    rows = [(i, " " * rnd.randrange(4) + rnd.choice("abcdefgh") * rnd.randrange(1, 4), None) for i in range(400)]
    got = X.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_hot_groups_small_shards_and_one_that_stays(spark, monkeypatch):
    """Some digests are sent to the rows, others shuffled; of texts under one doc_id that differ in white space, one stays."""
    monkeypatch.setattr(X, "HOT_SHARE", 4)
    monkeypatch.setattr(X, "SHARD_KEYS", 10)
    rows = [(i, "hot " * 3, None) for i in range(60)] + [(i, f"text {i % 70}", None) for i in range(100, 240)] + [(7, "a b", None), (7, "a\tb", None), (7, "a b", None)]
    got = X.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    stay = {}
    for r in got:
        if r.stays:
            assert r.kept
            stay.setdefault(r.text_sha256, set()).add((r.doc_id, r.text_hash))
    assert len(stay) == 72 and all(len(v) == 1 for v in stay.values())


def test_empty_table(spark):
    assert X.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_inserts_deletes_and_grows():
    index, live, rnd = X.CuckooIndex(buckets=2), {}, random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12000):
        key = rnd.choice(keys)
        if rnd.random() < 0.6:
            row, new = index.insert(key)
            assert new == (key not in live) and live.setdefault(key, row) == row
        else:
            assert index.delete(key) == (live.pop(key, None) is not None)
    assert len(index) == len(live) and index.resized
    assert all(index.find(k) == live.get(k) for k in keys)


def test_colliding_fingerprints_are_told_apart():
    index = X.CuckooIndex()
    a, b = b"\x07" * 31 + b"a", b"\x07" * 31 + b"b"
    index.insert(a)
    assert index.find(b) is None and index.false_hits
    index.insert(b)
    index.delete(a)
    assert index.find(a) is None and index.find(b) is not None


def test_live_index(spark):
    docs = lambda rows: X.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = X.build_index(docs([(1, "a"), (2, "b"), (3, "b")]))
    index = X.update_index(index, added=docs([(4, "c"), (0, "a")]), removed=docs([(9, "b")]))
    assert sorted((r.best_id, r.n_rows) for r in index.collect()) == [(0, 2), (4, 1)]
