import random

from assayspark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def brute(rows):
    chats = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        chats.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in chats.items():
        equal = [c for c, t in chats.items() if t == turns]
        if min(equal, key=lambda c: (c is None, c or 0)) == conv and not any(len(t) > len(turns) and t[: len(turns)] == turns for t in chats.values()):
            out.append((conv, len(turns), len(equal), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted(map(tuple, C.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def test_snapshots_copies_and_odd_rows(spark):
    rnd = random.Random(1)
    rows = []
    for conv in range(120):
        n = rnd.randrange(1, 5)
        rows += [(conv, t, rnd.choice(["user", "assistant"]) if t else "user", rnd.choice(["a", "b"]) if t else "hello", "x") for t in range(n)]
    rows += [(500, 1, None, None, "x"), (501, None, "user", "", "x"), (None, 0, "user", "z", "x"), (502, 0, "user", "y" * 200_000, "x"), (503, 0, "u", "ser", "x"), (504, 0, "us", "er", "x")]
    rows += [(505, 0, "user", "twice", "x"), (505, 0, "user", "twice", "x")]
    assert run(spark, rows) == brute(rows)


def test_order_matters(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (2, 0, "user", "b", ""), (2, 1, "user", "a", ""), (2, 2, "user", "c", ""), (3, 0, "user", "b", "")]
    assert run(spark, rows) == brute(rows) and len(run(spark, rows)) == 2


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
