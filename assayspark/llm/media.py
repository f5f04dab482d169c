"""Media columns: baseline JPEG, written and read with numpy.

decode_dc() reads any baseline (sequential, Huffman, 8-bit) JPEG: it walks the markers, decodes the scans and keeps the
DC coefficients only, which gives a thumbnail of one sample for each 8 x 8 block, and luminance is its first component.

store() writes bytes as a grey JPEG in which each byte is the sample value of one 8 x 8 block: the block is flat, its
quantised DC coefficient is the byte less 128, and so its DC-only thumbnail is the bytes themselves. The Huffman table
gives category c a code of 9 - c bits, so code and value bits take 9 bits for every difference; with an end-of-block
code of 7 bits a block takes two bytes. Such scans (all blocks equally long, as the tables show) are decoded in one
numpy step. Other scans are decoded bit position by bit position: numpy finds for all positions of a part of PART bytes
how long a symbol that starts there is, and a walk links them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import map_rows

UNIT = 64
MOST_BLOCKS = 8191  # on a side: 65535 samples
#: Zigzag index of a coefficient is not needed for DC; quantisation of all coefficients.
STEP = 8
PART = 1 << 20


@dataclass
class Table:
    """A Huffman table: code lengths by symbol, and for each 16-bit window the symbol and its code's length (0: none)."""

    lengths: dict[int, int]
    symbol: np.ndarray
    size: np.ndarray


def table(counts: bytes, symbols: bytes) -> Table:
    symbol, size = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    code, k, lengths = 0, 0, {}
    for n, count in enumerate(counts, 1):
        for s in symbols[k : k + count]:
            at, width = code << (16 - n), 1 << (16 - n)
            symbol[at : at + width], size[at : at + width] = s, n
            lengths[s] = n
            code += 1
        k += count
        code <<= 1
    return Table(lengths, symbol, size)


#: Counts of codes by length, and their symbols. Category c has 9 - c bits; the only AC symbol is end-of-block.
DC_COUNTS, DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC_COUNTS, AC_SYMBOLS = bytes([0] * 6 + [1] + [0] * 9), bytes([0])


def _words() -> np.ndarray:
    """The two bytes of a flat block for each DC difference from -255 to 255."""
    out = np.zeros(511, dtype=">u2")
    for d in range(-255, 256):
        c = abs(d).bit_length()
        bits = 9 - c  # canonical: 0, 10, 110, ...
        code = (1 << bits) - 2
        out[d + 255] = (code << c | (d if d >= 0 else d + (1 << c) - 1)) << 7
    return out


WORDS = _words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _grid(n: int) -> tuple[int, int]:
    """Columns and rows of blocks for n payload bytes (a multiple of UNIT): as few columns as the height allows."""
    columns = UNIT * -(-n // (UNIT * MOST_BLOCKS))
    return columns, -(-n // columns)


#: Payload bytes in one image.
MOST_PAYLOAD = UNIT * (MOST_BLOCKS // UNIT) * (MOST_BLOCKS - 1)


def _image(payload: np.ndarray) -> bytes:
    columns, rows = _grid(len(payload))
    values = np.zeros(columns * rows, dtype=np.int16)
    values[: len(payload)] = payload
    values -= 128
    scan = WORDS[np.diff(values, prepend=np.int16(0)) + 255].view(np.uint8)
    full = np.flatnonzero(scan == 0xFF)
    scan = np.insert(scan, full + 1, 0).tobytes() if len(full) else scan.tobytes()
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, struct.pack(">Q", len(payload))),
            _segment(0xDB, bytes([0]) + bytes([STEP] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_SYMBOLS),
            _segment(0xC4, bytes([0x10]) + AC_COUNTS + AC_SYMBOLS),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        )
    )


def store(data: bytes) -> bytes:
    """data, with bytes 0 up to a positive multiple of UNIT, as JPEG images one after the other (one up to 66 MB)."""
    payload = np.frombuffer(data + bytes(-len(data) % UNIT or (0 if data else UNIT)), dtype=np.uint8)
    return b"".join(_image(payload[i : i + MOST_PAYLOAD]) for i in range(0, len(payload), MOST_PAYLOAD))


@dataclass
class Picture:
    width: int
    height: int
    thumbnail: np.ndarray  # luminance, rows of blocks by columns of blocks
    comment: bytes
    end: int  # where the image's bytes end


def decode_dc(data: bytes, start: int = 0) -> Picture:
    """The image that starts there, by its DC coefficients."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image starts here")
    at, comment = start + 2, b""
    quant: dict[int, int] = {}
    tables: dict[int, Table] = {}
    parts: list[tuple[int, int, int, int]] = []
    width = height = interval = 0
    planes: dict[int, np.ndarray] = {}
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = table(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            chosen = [(body[i], body[i + 1]) for i in range(1, 1 + 2 * body[0], 2)]
            runs, at = _runs(data, at)
            planes |= _scan(runs, chosen, parts, tables, width, height, interval)
    first, _, _, q = parts[0]
    light = np.clip(np.round(planes[first] * (quant[q] / 8)) + 128, 0, 255).astype(np.uint8)
    return Picture(width, height, light, comment, at + 2)


def _runs(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded runs between restart markers, without stuffed bytes, and where the next other marker stands."""
    runs, start = [], at
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] == 0:
            at += 2
            continue
        runs.append(data[start:at].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= data[at + 1] <= 0xD7:
            return runs, at
        start = at = at + 2


def _scan(runs: list[bytes], chosen: list, parts: list, tables: dict[int, Table], width: int, height: int, interval: int) -> dict[int, np.ndarray]:
    """DC coefficients by component, a row for each row of blocks."""
    high, tall = max(p[1] for p in parts), max(p[2] for p in parts)
    by_id = {p[0]: p for p in parts}
    if len(chosen) == 1:  # blocks follow the component's own grid
        c, which = chosen[0]
        _, h, v, _ = by_id[c]
        columns, rows = -(-(-(-width * h // high)) // 8), -(-(-(-height * v // tall)) // 8)
        order = [(c, which)]
        units, shape = columns * rows, {c: (rows, columns, 1, 1)}
    else:
        columns, rows = -(-width // (8 * high)), -(-height // (8 * tall))
        order = [(c, which) for c, which in chosen for _ in range(by_id[c][1] * by_id[c][2])]
        units, shape = columns * rows, {c: (rows, columns, by_id[c][2], by_id[c][1]) for c, _ in chosen}
    values: dict[int, list[np.ndarray]] = {c: [] for c, _ in chosen}
    left = units
    for run in runs:
        n = min(left, interval or left)
        left -= n
        for c, diffs in _differences(run, n, order, tables).items():
            values[c].append(np.cumsum(diffs))
    out = {}
    for c, (r, k, v, h) in shape.items():
        out[c] = np.concatenate(values[c]).reshape(r, k, v, h).transpose(0, 2, 1, 3).reshape(r * v, k * h)
    return out


def _differences(run: bytes, units: int, order: list, tables: dict[int, Table]) -> dict[int, np.ndarray]:
    """DC differences by component of one run of `units` units, each with the blocks in order."""
    pairs = [(c, tables[which >> 4], tables[16 + (which & 15)]) for c, which in order]
    _, dc, ac = pairs[0]
    totals = {n + s for s, n in dc.lengths.items()}
    if len(pairs) == 1 and len(totals) == 1 and set(ac.lengths) == {0}:
        bits, end = totals.pop(), ac.lengths[0]
        if bits + end == 16:  # a block is a two-byte word
            words = np.frombuffer(run, dtype=">u2", count=units).astype(np.int64)
            if (words & ((1 << end) - 1)).any():  # the code of a table's only symbol is all zeros
                raise ValueError("a block doesn't end where it should")
            sizes = dc.symbol[words].astype(np.int64)
            return {pairs[0][0]: _values(words >> end & ((1 << sizes) - 1), sizes)}
    return _walk(run, units, pairs)


def _values(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed values from their bits: those with a leading 0 are negative."""
    return np.where((sizes > 0) & (bits < (1 << np.maximum(sizes - 1, 0))), bits - (1 << sizes) + 1, bits)


def _windows(run: bytes) -> np.ndarray:
    """The 16 bits from each bit position on; past the end there are ones."""
    padded = np.frombuffer(run + b"\xff" * 4, dtype=np.uint8).astype(np.uint32)
    triple = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]
    return ((triple[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).reshape(-1)


def _walk(run: bytes, units: int, pairs: list) -> dict[int, np.ndarray]:
    """DC differences by following symbol after symbol; what is known of a part's bit positions is 6 bytes for each."""
    tables = {(id(d), id(a)): (d, a) for _, d, a in pairs}
    total, steps, low, high = 8 * len(run), {}, 0, 0
    windows = np.zeros(0, dtype=np.uint32)

    def load(at: int) -> None:
        nonlocal low, high, windows
        low = at // 8 * 8
        windows = _windows(run[low // 8 : low // 8 + PART + 16])
        high = low + min(len(windows), 8 * PART)
        for key, (dc, ac) in tables.items():
            symbols = ac.symbol[windows]
            first = np.where(dc.size[windows] > 0, dc.size[windows] + dc.symbol[windows], 0)
            later = np.where(ac.size[windows] > 0, ac.size[windows] + (symbols & 15), 0)
            steps[key] = tuple(x.astype(np.uint8).tobytes() for x in (first, later, np.where(symbols == 0, 64, (symbols >> 4) + 1)))

    order = [(i, id(dc), id(ac), dc) for i, (_, dc, ac) in enumerate(pairs)]
    values: list[list[tuple[int, int]]] = [[] for _ in pairs]
    at = 0
    for _ in range(units):
        for i, d, a, dc in order:
            if at >= high or not steps:
                load(at)
            window = int(windows[at - low])
            size = int(dc.symbol[window])
            start = at + int(dc.size[window])
            step = steps[d, a][0][at - low]
            values[i].append((start, size))
            k = 1
            while step and (at := at + step) <= total and k < 64:
                if at >= high:
                    load(at)
                later, skip = steps[d, a][1], steps[d, a][2]
                k += skip[at - low]
                step = later[at - low]
            if not step or at > total:
                raise ValueError("the scan ends early, or holds a code that no table has")
    out: dict[int, list[np.ndarray]] = {}
    bits = np.frombuffer(run + b"\xff" * 8, dtype=np.uint8)
    for kept, (c, _, _) in zip(values, pairs, strict=True):
        places, sizes = (np.array(x, dtype=np.int64) for x in zip(*kept, strict=True))
        value = np.zeros(len(places), dtype=np.int64)
        for n in range(int(sizes.max(initial=0))):
            more = n < sizes
            p = places[more] + n
            value[more] = value[more] << 1 | (bits[p >> 3] >> (7 - (p & 7)) & 1)
        out.setdefault(c, []).append(_values(value, sizes))
    return {c: np.stack(v, axis=1).reshape(-1) for c, v in out.items()}


def restore(media: bytes) -> tuple[bytes, list[Picture]]:
    """The payload of store() and its pictures."""
    found, payload, at = [], [], 0
    while at < len(media):
        picture = decode_dc(media, at)
        payload.append(picture.thumbnail.tobytes()[: struct.unpack(">Q", picture.comment)[0]])
        found.append(picture)
        at = picture.end
    return b"".join(payload), found


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8 x 8 grid of means is above the mean of them all."""
    rows, columns = (np.linspace(0, n, 9).astype(int) for n in thumbnail.shape)
    sums = np.pad(thumbnail.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    lo, hi = (rows[:-1], columns[:-1]), (np.maximum(rows[1:], rows[:-1] + 1).clip(max=thumbnail.shape[0]), np.maximum(columns[1:], columns[:-1] + 1).clip(max=thumbnail.shape[1]))
    area = (hi[0] - lo[0])[:, None] * (hi[1] - lo[1])[None, :]
    total = sums[np.ix_(hi[0], hi[1])] - sums[np.ix_(lo[0], hi[1])] - sums[np.ix_(hi[0], lo[1])] + sums[np.ix_(lo[0], lo[1])]
    means = total / np.maximum(area, 1)
    return np.packbits(means > means.mean()).tobytes().hex()


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the UTF-8 text and media, the JPEG that holds it; a null text is empty."""

    def work(rows: pa.RecordBatch) -> dict:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        return {"doc_id": rows.column("doc_id"), "n_bytes": [len(d) for d in data], "media": [store(d) for d in data]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, "text", "doc_id long, n_bytes long, media binary", work)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_features(media: DataFrame) -> DataFrame:
    """Features of a media column (doc_id, n_bytes, media), all from the stored bytes: FEATURES.

    feature is width x height of each image and the hash of its thumbnail. Rows whose media is null have null features.
    Media that can't be read (cut off, progressive, no image of store() and so on) have their bytes and hash, null for
    the rest, and say why in error, which is null for all others.
    """

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            payload, pictures = restore(data)
        except (ValueError, IndexError, KeyError, struct.error) as error:
            return None, None, None, *stored, None, f"{type(error).__name__}: {error}"
        feature = ",".join(f"{p.width}x{p.height}:{thumbnail_hash(p.thumbnail)}" for p in pictures)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *stored, feature, None

    def work(rows: pa.RecordBatch) -> dict:
        found = list(zip(*map(one, rows.column("media").to_pylist()), strict=True)) or [()] * 7
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
        return {"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes")} | {n: list(v) for n, v in zip(names, found, strict=True)}

    return map_rows(media, "media", FEATURES, work)


def text_media(docs: DataFrame) -> DataFrame:
    """FEATURES of every row of docs, its text stored as JPEG and read back.

    A null or empty text is a payload of 64 bytes 0. Equal texts have equal values; repeated rows and null doc_ids stay
    as they are. An empty table gives an empty result; further columns are ignored.
    """
    return read_features(store_texts(docs))
