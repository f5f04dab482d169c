import random
import re

import public_tokenizers
import pytest
import sentencepiece

from assayspark.llm import pieces as P

TEXTS = ["", " ", "a", "Hello world", "  two  spaces  ", "tab\tand\nline\r\n", "ünïcödé 日本語 🙂 ▁ x▁y", "▁", "0123 don't", "x" * 3000, "\0\x07 odd", "<s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def v():
    return P.vocabulary(None)


def words(rnd, n):
    return " ".join(rnd.choice(["the", "of", "thanedble", "réeux", "Über", "x" * rnd.randrange(1, 9), "anea.", "\n"]) for _ in range(n))


def test_without_dropout_as_the_library(v):
    model, rnd = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL)), random.Random(1)
    encode = P.Encoder(v, rate=0.0)
    for text in [t for t in TEXTS if "▁" not in t and "<" not in t] + [words(rnd, 80) for _ in range(40)]:
        assert encode(text).tolist() == model.encode(text), text


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_lossless(v, rate):
    rnd = random.Random(2)
    encode = P.Encoder(v, seed=3, rate=rate)
    for text in TEXTS + [words(rnd, 50) for _ in range(40)]:
        assert P.decode(encode(text), v) == text


def test_seeds_and_rates(v):
    rnd = random.Random(5)
    text = words(rnd, 400)
    a, b, c = (P.Encoder(v, seed=s)(text).tolist() for s in (1, 1, 2))
    assert a == b != c
    plain, half, all_skipped = (len(P.Encoder(v, rate=r)(text)) for r in (0.0, 0.5, 1.0))
    assert plain < len(a) < half < all_skipped
    share = sum(P.skipped(k, i, i * 7, int(0.1 * 2**32)) for k in range(100) for i in range(100)) / 10_000
    assert 0.08 < share < 0.12


def test_queries(spark):
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate([None, *TEXTS, TEXTS[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = P.round_trip(docs).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    back = {r.doc_id: r.text for r in P.decode_ids(P.encode_texts(docs)).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert P.round_trip(docs.limit(0)).collect() == []


def brute(word, v, key, rate):
    """Merge-dropout by its definition: of all candidates that were not skipped, the best by score, then place, is drawn for."""
    symbols, out_of = [(c, i) for i, c in enumerate(word)], set()
    while True:
        found = [(-v.scores[a + b], i, a + b, k) for k, ((a, i), (b, _)) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in v.scores and (i, a + b) not in out_of]
        if not found:
            return [v.ids[s] if s in v.ids else v.bytes[b] for s, _ in symbols for b in (s.encode() if s not in v.ids else b"x")]
        _, i, joined, k = min(found)
        if rate and P.skipped(key, i, v.ids[joined], int(rate * 2**32)):
            out_of.add((i, joined))
        else:
            symbols[k : k + 2] = [(joined, i)]


def runs(text):
    """Runs of a text by their rule: letters, other characters, and the text's own U+2581 are apart; spaces lead."""
    return re.findall(r" *(?:[^\W\d_²³¹]+|(?:(?![^\W\d_²³¹])[^ ▁])+)|▁| +", " " + text if text else "")


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_against_brute_force(v, rate):
    """Whole texts, with runs of every width and of more than the widest, against the definition."""
    rnd = random.Random(8)
    odd = ["a ▁ b", "x" * 64 + " " * 70 + "y" * 65, "漢字" * 40 + "é" * 30, "of▁ the", *TEXTS]
    texts = odd + [words(rnd, 60) for _ in range(20)] + ["".join(rnd.choice("abcdeioru .,9é") for _ in range(900))]
    for text, got in zip(texts, P.Encoder(v, 3, rate).encode(texts), strict=True):
        units = runs(text)
        keys = P.occurrence_keys(3, text, 0, len(units)).tolist()
        want = []
        for u, k in zip(units, keys, strict=True):
            want += [v.bytes[b] for b in u.encode()] if u == "▁" else brute(u.replace(" ", "▁"), v, k, rate)
        assert got.tolist() == want, text[:80]


def test_long_texts_are_cut_where_runs_end(v):
    """A text longer than a window has the ids of its runs drawn one by one; the windows leave no trace."""
    rnd = random.Random(9)
    text = words(rnd, 150_000) + "  " + "z" * 700
    assert len(list(P.windows(text))) > 1 and "".join(P.windows(text)) == " " + text
    encode = P.Encoder(v, 5, 0.2)
    whole = encode(text)
    assert P.decode(whole, v) == text
    small, P.WINDOW = P.WINDOW, 1000
    try:
        assert (encode(text) == whole).all()
    finally:
        P.WINDOW = small


def test_each_occurrence_is_drawn_anew(v):
    """A word of one merge is split in a tenth of its occurrences, and a longer one has many segmentations."""
    pairs = sorted(p for p in v.ids if len(p) == 2 and p.isalpha() and p.isascii())
    for word in pairs[:20]:
        ids = P.Encoder(v, seed=4)("\n".join([word] * 2000)).tolist()
        assert 0.07 < 1 - ids.count(v.ids[word]) / 2000 < 0.13, word
    ids = P.Encoder(v, seed=4)("\n".join(["segmentation"] * 3000)).tolist()
    line = v.bytes[10]
    found, now = set(), []
    for i in ids:
        if i == line:
            found.add(tuple(now))
            now = []
        else:
            now.append(i)
    assert len(found) > 20
    text = "the house " * 300
    ids = P.Encoder(v, seed=4)(text).tolist()
    assert ids == P.Encoder(v, seed=4)(text).tolist() and P.Encoder(v, seed=4)(text + ".").tolist()[:50] != ids[:50]
