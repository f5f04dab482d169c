import random
import re

import pytest

from assayspark.llm import license_scan as L


def base(text):
    """Words and phrase places by plain loops."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for i in range(len(words)) for p, label in L.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def run(spark, texts):
    rows = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, label string, w int").repartition(3)
    got = {r.doc_id: r for r in L.scan(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == base(t), t
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(",")))
        assert 0 <= got[i].score <= 1
    return got


def test_phrases(spark):
    rnd = random.Random(1)
    bits = ["MIT", "License", "general", "public", "license,", "Apache", "\n", "é", "K", "mit-license", "mitlicense", "Kapache license"]
    texts = [None, "", " ", "...", "MIT", "mit license mit license", "x" * 100_000, "MIT License", "general public license " * 5000, "the apache\n\tLicense."]
    texts += [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(60)]
    run(spark, texts)


def test_notices(spark):
    terms = L.NOTICES["mit-terms"]
    w = terms.split()
    changed = " ".join([*w[:10], "kindly", *w[10:20], *w[21:]])
    scattered = " ".join(f"{x} filler words here" for x in w)
    got = run(spark, ["Intro. " + terms.title() + " end", changed, scattered, " ".join(w[:8]), f"{terms} and again {terms}", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."])
    assert got[0].labels == "mit-terms" and got[0].score == 1 and (got[0].spans[0].low, got[0].spans[0].last) == (1, len(w))
    assert got[1].labels == "mit-terms" and 0.7 <= got[1].score < 1 and len(got[1].spans) == 1
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == ""
    assert [s.low for s in got[4].spans] == [0, len(w) + 2]
    assert got[5].labels == "apache,apache-2.0-line" and got[6].labels == "cc-by-nc-4.0"


def edited(rnd, w, how, n):
    """n words put in, left out, swapped with the next or replaced, at places well apart."""
    w, step = list(w), len(w) // n
    for i in reversed([j * step + rnd.randrange(2, max(3, step - 2)) for j in range(n)]):
        if how == "in":
            w.insert(i, f"word{rnd.randrange(99)}")
        elif how == "out":
            del w[i]
        elif how == "swap":
            w[i - 1], w[i] = w[i], w[i - 1]
        else:
            w[i] = "other"
    return w


@pytest.mark.parametrize("n", [1, 2, 4])
def test_edited_licences_keep_their_labels(spark, n):
    """Each whole text with words put in, left out, swapped and replaced, among other words: its label, one span, no label of another licence."""
    rnd, made = random.Random(n), []
    for label, text in L.TEXTS.items():
        for how in ("in", "out", "swap", "replaced"):
            lead = [f"lead{i}" for i in range(rnd.randrange(40))]
            made.append((label, len(lead), edited(rnd, text.split(), how, n), lead))
    got = run(spark, [" ".join([*lead, *w, *["tail"] * 9]) for _, _, w, lead in made])
    family = {label: label.split("-")[0] for label in L.NOTICES | L.TEXTS}
    for i, (label, at, w, _) in enumerate(made):
        own = [s for s in got[i].spans if s.label == label]
        assert len(own) == 1 and abs(own[0].low - at) <= 6 and abs(own[0].last - (at + len(w) - 1)) <= 6, (label, own)
        assert L.LEAST_SHARE <= own[0].share <= 1 and got[i].score >= own[0].share
        found = set(got[i].labels.split(","))
        assert ("bsd-2-clause-text" in found) + ("bsd-3-clause-text" in found) == (family[label] == "bsd"), (label, found)
        assert {family.get(x, x) for x in found} <= {family[label], {"unlicense": "public"}.get(family[label], ""), "apache", "gpl"}, (label, found)


def test_many_edits_over_a_long_text(spark):
    """More edits than one diagonal survives, up to DRIFT words more than the template has."""
    w = L.TEXTS["bsd-3-clause-text"].split()
    texts = [" ".join(edited(random.Random(k), w, how, k)) for how in ("in", "out", "swap") for k in (8, L.DRIFT)]
    for r in run(spark, texts).values():
        assert "bsd-3-clause-text" in r.labels and "bsd-2-clause-text" not in r.labels


def test_copies_side_by_side_and_far_apart(spark):
    w = L.TEXTS["mit-text"].split()
    got = run(spark, [" ".join([*w, *w]), " ".join([*w, *["between"] * 500, *edited(random.Random(3), w, "in", 3), "and", *w])])
    assert [(s.low, s.last) for s in got[0].spans if s.label == "mit-text"] == [(0, len(w) - 1), (len(w), 2 * len(w) - 1)]
    assert [s.low for s in got[1].spans if s.label == "mit-text"] == [0, len(w) + 500, 2 * len(w) + 504]


def test_parts_and_scattered_words_are_no_licence(spark):
    rnd = random.Random(7)
    texts = []
    for text in L.TEXTS.values():
        w = text.split()
        grams = [w[i : i + 4] for i in range(0, len(w), 4)]
        rnd.shuffle(grams)
        texts += [" ".join(w[: len(w) * 6 // 10]), " ".join(" ".join(g) + " filler of ours goes here" for g in grams), " ".join(rnd.sample(w, len(w)))]
    for i, r in run(spark, texts).items():
        assert not set(r.labels.split(",")) & L.TEXTS.keys(), (i, r.labels)


def test_own_templates(spark):
    rows = spark.createDataFrame([(1, "Licensed as: My Terms!"), (2, "one two three four five six"), (3, "single")], "doc_id long, text string")
    own = {"short": "my terms", "one": "single", "long": "One two-three four, five six", "none": " .,"}
    assert {r.doc_id: r.labels for r in L.scan(rows, own).collect()} == {1: "short", 2: "long", 3: "one"}
    with pytest.raises(ValueError):
        L.scan(rows, {"big": "x " * (L.MOST_WORDS + 1)})


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "mit license"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_base) for r in L.scan(rows).collect()) == [("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert L.scan(rows.limit(0)).collect() == []
