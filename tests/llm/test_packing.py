import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assayspark.llm import packing as P


def brute_fewest(counts, size):
    """By trying all bins for each item."""
    items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= size:
                put(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


def held(plan):
    return Counter({x: sum(k * n for f, n in plan for y, k in f if y == x) for x in {y for f, _ in plan for y, _ in f}})


def test_small_plans_are_the_best():
    rnd, worse = random.Random(3), 0
    for _ in range(60):
        size = rnd.choice([10, 20, 37])
        counts = Counter(rnd.randint(1, size) for _ in range(9))
        plan = P.plan(counts, size)
        assert held(plan) == counts and all(sum(x * k for x, k in f) <= size for f, _ in plan)
        worse += sum(n for _, n in plan) - brute_fewest(counts, size)
    assert worse <= 1


def test_large_plan_meets_the_bound():
    rnd = random.Random(4)
    counts = Counter(min(1024, int(rnd.expovariate(1 / 300)) + 1) for _ in range(20000))
    plan = P.plan(counts)
    assert held(plan) == counts
    assert sum(n for _, n in plan) <= P.least_sequences(counts, 1024) * 1.001 + 1


def test_completion_wastes_least():
    assert sum(x * k for x, k in P.complete(10, [6, 5, 4, 3], {6: 1, 5: 2, 4: 1, 3: 1})) == 10
    assert P.complete(0, [3], {3: 1}) == []


def test_exact_completion_against_all_fillings():
    """Without a limit of steps, no filling of the room wastes less, and none of its lengths can be swapped for a larger one."""
    rnd = random.Random(7)
    for _ in range(200):
        room, counts = rnd.randrange(1, 60), Counter(rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 9)))
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        fill = P.complete(room, sorted(counts, reverse=True), counts, steps=None)
        assert sum(x * k for x, k in fill) == max(sums) and all(k <= counts[x] for x, k in fill)
        held_now = Counter(dict(fill))
        for x, k in fill:
            free = [y for y in counts if y > x and counts[y] > held_now[y] and y - x <= room - max(sums)]
            assert not free and k


def test_report():
    assert P.report(P.plan({1024: 3, 512: 4, 100: 1})) == (6, 6)


def test_ids_are_those_of_the_named_tokenizer():
    """Random Unicode, white space, digits, contractions and special strings, by the thousand."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rnd = random.Random(11)
    bits = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2028", "\u3000", "\u0301", "'s", "'LL", "’t", "ſ", "İ", "ß", "12", "²", "Ⅷ", "日本", "🙂", "\u200d", "\x00", "\x85", "<|endoftext|>", "the", "Über"]
    char = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FF), rnd.randrange(0x300, 0xD7FF), rnd.randrange(0xE000, 0x10FFFF)]))
    texts = ["".join(rnd.choice(bits) if rnd.random() < 0.5 else char() for _ in range(rnd.randrange(1, 40))) for _ in range(5000)]
    encode = P.encoder(None)
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == want.ids, ascii(text)


def test_whole_query(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rnd = random.Random(6)
    texts = [None, "", " ", "a \n b  c\t", "<|endoftext|> it's we'll", "é日本 x" * 900, "x" * 5000, *(" ".join(rnd.choice(["the", "of", "thanedble", "\n", "É.", "12", ""]) for _ in range(rnd.randrange(1, 1500))) for _ in range(60))]
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(texts)] + [(8, texts[8], 7)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for k in range(-(-len(ids) // 1024)):
            n = (len(ids) % 1024 or 1024) if k == 0 else 1024
            want[doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= P.least_sequences(Counter(r.length for r in got), 1024) + 1


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
