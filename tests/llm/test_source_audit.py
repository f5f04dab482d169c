import random
import re
from collections import Counter

import pyarrow as pa

from assayspark.llm import source_audit as A


def brute(docs):
    docs = [tuple(x or "" for x in d) for d in docs]  # lang, source, text
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) for *_, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(d[1], t) for d, t in zip(docs, terms, strict=True) if d[0] == lang]
        df = Counter(w for _, t in mine for w in set(t))
        kept = {w for w, n in df.items() if n >= 3}
        counts = {s: Counter() for s, _ in mine}
        for s, t in mine:
            counts[s].update(w for w in t if w in kept)
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            parts = {"pair": [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in counts if t != s], "term": [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= 200]
    return sorted(out)


def check(spark, docs, parts=5):
    rows = spark.createDataFrame([(i % 3 or None, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, term string, rank int")
    got = sorted(map(tuple, A.audit(rows.repartition(parts)).collect()))
    assert got == brute(docs)
    return got


def test_random(spark):
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "aZéкA𝒳" for b in ("", "b", "É", "zz")]
    docs = [(rnd.choice(["en", "de", None]), rnd.choice(["s1", "S1", "s2", None, "é"]), " ".join(rnd.choices(words, [1 + i * i for i in range(len(words))], k=rnd.randrange(30)))) for _ in range(120)]
    assert len(check(spark, docs)) > 100


def test_groups_without_terms_and_languages_that_keep_none(spark):
    docs = [("en", "a", "one two one"), ("en", "b", None), ("en", "b", "one,TWO;one\x00one"), ("en", "c", "one"), ("en", "d", ""), ("fr", "a", "le la"), ("fr", "b", "12 34"), ("xx", "only", None)]
    got = check(spark, docs)
    assert [x for x in got if x[0] == "fr"] == [("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)]
    assert not [x for x in got if x[0] == "xx"]


def test_ranks_are_cut_at_200_with_ties_by_item(spark):
    many = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs = [("en", "a", " ".join(many))] * 3 + [("en", "b", "other words")] * 4
    got = check(spark, docs)
    assert [x[3] for x in sorted(got, key=lambda x: x[5]) if x[1:3] == ("a", "term")] == many[:200]


def test_counts_handed_on_early(monkeypatch):
    rows = [("en", f"s{i % 3}", f"hot {i} " + "w" * (i % 5 + 1) + " hot") for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])

    def summed():
        total = Counter()
        for out in A._counts(iter([batch, batch])):
            for r in out.to_pylist():
                total[r["lang"], r["source"], r["term"]] += complex(r["n"], r["df"])
        return total

    whole = summed()
    monkeypatch.setattr(A, "COUNTED", 2)
    assert summed() == whole and whole["en", "s0", "hot"] == complex(56, 28)


def test_long_texts(spark):
    check(spark, [("en", f"s{i % 3}", f"tail long word{i}") for i in range(9)] + [("en", "s0", "long tail " * 200_000), ("en", "s1", "x" * 1_000_000)], 3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert A.audit(empty).collect() == [] and A.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"]
