import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from assayspark.llm import media as M

DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
#: A small AC table: end of block, runs of 0 and 3 with sizes 1 to 3, sixteen zeros.
AC = (bytes([0, 1, 1, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]), bytes([0x00, 0x01, 0x02, 0x03, 0x31, 0x32, 0x33, 0xF0]))


def codes(counts, symbols):
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[k : k + count]:
            out[s] = f"{code:0{n}b}"
            code += 1
        k, code = k + count, code << 1
    return out


def value_bits(v):
    c = abs(v).bit_length()
    return f"{v if v > 0 else v + (1 << c) - 1:0{c}b}" if c else ""


def write(width, height, parts, interval, rnd):
    """A JPEG of random coefficients by a bit-string writer, and the DC values of its first component."""
    dc, ac = codes(*DC), codes(*AC)
    high, tall = max(h for h, _ in parts), max(v for _, v in parts)
    if len(parts) == 1:
        columns, rows, order = -(-width // 8), -(-height // 8), [0]
    else:
        columns, rows = -(-width // (8 * high)), -(-height // (8 * tall))
        order = [i for i, (h, v) in enumerate(parts) for _ in range(h * v)]
    runs, bits, last, seen = [], "", [0] * len(parts), []
    for unit in range(columns * rows):
        if interval and unit and unit % interval == 0:
            runs.append(bits)
            bits, last = "", [0] * len(parts)
        for i in order:
            v = rnd.randrange(-500, 500) if rnd.random() < 0.8 else last[i]
            d, last[i] = v - last[i], v
            if i == 0:
                seen.append(v)
            bits += dc[abs(d).bit_length()] + value_bits(d)
            k = 1
            while k < 60 and rnd.random() < 0.6:
                s = rnd.choice(AC[1][1:])
                if k + (s >> 4) + 1 > 64:
                    break
                bits += ac[s] + (value_bits(rnd.choice([-1, 1]) * rnd.randrange(1 << ((s & 15) - 1), 1 << (s & 15))) if s & 15 else "")
                k += (s >> 4) + 1
            if k < 64:
                bits += ac[0]
    runs.append(bits)
    body = b""
    for n, run in enumerate(runs):
        run += "1" * (-len(run) % 8)
        body += (b"" if not n else bytes([0xFF, 0xD0 + (n - 1) % 8])) + int("1" + run, 2).to_bytes(len(run) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00")
    seg = M._segment
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts))
    scan = bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0])
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [2] * 64)) + seg(0xC0, frame) + seg(0xC4, b"\0" + DC[0] + DC[1] + b"\x10" + AC[0] + AC[1])
    out += (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, scan) + body + b"\xff\xd9"
    h, v = parts[0] if len(parts) > 1 else (1, 1)
    return out, np.array(seen).reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)


@pytest.mark.parametrize("parts", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 3])
@pytest.mark.parametrize("part", [1 << 20, 40])
def test_any_baseline_image(parts, interval, part, monkeypatch):
    monkeypatch.setattr(M, "PART", part)
    rnd = random.Random(len(parts) + interval)
    data, want = write(70, 45, parts, interval, rnd)
    got = M.decode_dc(data)
    assert (got.width, got.height, got.end) == (70, 45, len(data))
    assert (got.thumbnail == np.clip(np.round(want * 2 / 8) + 128, 0, 255)).all()


def test_stored_bytes_come_back_both_ways(monkeypatch):
    rnd = random.Random(3)
    for data in (b"", b"a", bytes(64), bytes(range(256)) * 3, bytes([255, 0] * 500), rnd.randbytes(70_000), rnd.randbytes(64 * 8191 + 1)):
        media = M.store(data)
        payload, pictures = M.restore(media)
        assert payload == data + bytes(-len(data) % 64 or (0 if data else 64))
        assert all(p.width <= 65535 and p.height <= 65535 for p in pictures)
        if len(data) < 2000:  # the slow way reads the same
            with monkeypatch.context() as m:
                m.setattr(M, "_differences", lambda run, units, order, tables: M._walk(run, units, [(c, tables[w >> 4], tables[16 + (w & 15)]) for c, w in order]))
                assert M.restore(media)[0] == payload
    monkeypatch.setattr(M, "MOST_PAYLOAD", 128)
    data = rnd.randbytes(1000)
    assert M.restore(M.store(data))[0] == data + bytes(24)
    assert len(M.restore(M.store(data))[1]) == 8


def test_thumbnail_hash():
    light = np.zeros((16, 64), dtype=np.uint8)
    light[:8] = 200
    assert M.thumbnail_hash(light) == "ffffffff00000000"
    assert M.thumbnail_hash(np.full((1, 64), 9, dtype=np.uint8)) == "0" * 16


def test_bad_images_are_rows_with_an_error(spark):
    good, data = M.store(b"good"), write(70, 45, [(2, 2), (1, 1), (1, 1)], 0, random.Random(1))[0]
    eob = bytearray(good)
    at = good.rindex(b"\x00\x3f\x00") + 3
    eob[at + 1] ^= 1
    bad = [b"", b"GIF89a", good[:-40], data[:-60], data.replace(b"\xff\xc0", b"\xff\xc2"), good[:20], bytes(eob), data, b"\xff\xd8\xff\xd9"]
    rows = spark.createDataFrame([(i, 4, b) for i, b in enumerate([good, None, *bad])], "doc_id long, n_bytes long, media binary").repartition(3)
    got = {r.doc_id: r for r in M.read_features(rows).collect()}
    assert len(got) == 2 + len(bad)
    assert got[0].error is None and got[0].payload_bytes == 64 and got[1].error is None and got[1].media_bytes is None
    for i, b in enumerate(bad, 2):
        assert got[i].media_bytes == len(b)
        assert b == b"" or (got[i].error and got[i].feature is None), i


def brute_thumbnail_hash(light):
    """An 8 x 8 grid of means by plain loops."""
    rows, columns = ([int(n * k / 8) for k in range(9)] for n in light.shape)
    means = []
    for r in range(8):
        for c in range(8):
            cell = [int(light[y, x]) for y in range(rows[r], min(max(rows[r + 1], rows[r] + 1), light.shape[0])) for x in range(columns[c], min(max(columns[c + 1], columns[c] + 1), light.shape[1]))]
            means.append(sum(cell) / max(1, len(cell)))
    bits = "".join("1" if m > np.mean(means) else "0" for m in means)
    return f"{int(bits, 2):016x}"


def test_feature_against_brute_force():
    rnd = random.Random(4)
    for n in (1, 64, 200, 3000, 64 * 70):
        media = M.store(rnd.randbytes(n))
        picture = M.restore(media)[1][0]
        assert M.thumbnail_hash(picture.thumbnail) == brute_thumbnail_hash(picture.thumbnail)


def test_whole_query(spark):
    texts = [None, "", "abc", "é" * 33, "日本\n" * 30000, "x" * 64, "abc"]
    rows = spark.createDataFrame([(i if i != 2 else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary").repartition(3)
    got = {(r.doc_id): r for r in M.text_media(rows).collect()}
    for i, t in enumerate(texts):
        r, data = got[i if i != 2 else None], (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.store(data)), hashlib.sha256(M.store(data)).hexdigest())
    assert got[None][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    assert M.text_media(rows.limit(0)).collect() == []
