"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the merge type: the characters of a word are symbols, candidates (neighbouring symbols whose join is a
piece) stand in an agenda by score and place, and the best is merged until none is left. With dropout, a candidate that
comes up is skipped for good if a keyed hash of the seed, the text, the word's place in it, the candidate's place and its
piece falls below the rate. Equal seeds give equal results on every machine; each occurrence of a word is drawn anew.
Symbols that are no piece become bytes.

No piece of the vocabulary joins a word to the space that follows it, or a letter to what is no letter, so runs of letters
and of other characters (with the spaces before them) are encoded one by one. The agendas of very many runs are worked off
side by side in numpy: in each turn, every run draws for its best candidate and merges or skips it. A run's candidates are
a column of numbers (rank and place), whose least is the head of its agenda. Runs of more than WIDEST symbols have a heap.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import map_rows

MODEL = "piece_bpe_32k.model"
SEED, RATE = 7, 0.1
SPACE = "▁"
_LETTER = r"[^\W\d_²³¹]"
_MIXED = re.compile(rf"{_LETTER}(?!{_LETTER})[^{SPACE}]|(?!{_LETTER})[^{SPACE}]{_LETTER}")
_NEW_WORD = re.compile("(?<! ) ")
_MASK = 0xFFFFFFFF
#: What a character is to the runs: a space, a letter, something else, or the text's own U+2581, which is a run of its own.
_BLANK, _ALPHA, _OTHER, _OWN = range(4)
#: Widths that runs are sorted into, and the characters and runs that are worked off at once.
WIDTHS = (3, 5, 8, 12, 20, 64)
WIDEST, WINDOW, RUNS = WIDTHS[-1], 500_000, 16_384
_PLACES = 6  # bits for a place below WIDEST
_LAST = np.int32((1 << 31) - 1)  # no candidate


class Vocabulary:
    """Pieces and scores of a merge-type model, with its byte pieces, as tables for strings and for numpy.

    Symbols are numbers: the pieces' ids, then one for each character that is no piece, as they come up. The table of
    pairs is open-addressed: `slot` has the pair's key, `rank` the place of the joined piece in the order of scores.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.texts = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.pieces)]
        if any(SPACE in p.lstrip(SPACE) or _MIXED.search(p) for p in self.ids):
            raise ValueError("a piece joins words; this vocabulary can't be encoded word by word")
        self._tables()

    def _tables(self) -> None:
        order = sorted(self.ids, key=lambda p: (-self.scores[p], self.ids[p]))
        self.id_of_rank = np.array([self.ids[p] for p in order], dtype=np.int64)
        self.symbol = np.full(0x110000, -1, dtype=np.int32)  # by code point
        self.kind = np.full(0x110000, -1, dtype=np.int8)
        self.output = [(i,) for i in range(len(self.pieces))]
        self.single: dict[str, int] = {}
        for c in {c for p in self.ids for c in p}:
            self._character(c)
        pairs: dict[int, int] = {}
        for rank, p in enumerate(order):
            for k in range(1, len(p)):
                a, b = (self.single.get(x, self.ids.get(x)) for x in (p[:k], p[k:]))
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.shift = 64 - (4 * len(pairs)).bit_length()
        size = 1 << (64 - self.shift)
        self.slot, self.rank = np.full(size, -1, dtype=np.int64), np.full(size, _LAST >> _PLACES, dtype=np.int32)
        for key, rank in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> self.shift
            while self.slot[at] >= 0:
                at = (at + 1) % size
            self.slot[at], self.rank[at] = key, rank

    def _character(self, c: str) -> int:
        """The symbol of a character, and its place in the tables by code point."""
        if c not in self.single:
            own = self.ids.get(c)
            if own is None:
                own = len(self.output)
                self.output.append(tuple(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")))
            self.single[c] = own
            self.symbol[ord(c)] = own
        return self.single[c]

    def characters(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and kinds of a text's characters. Spaces are SPACE, and SPACE itself is bytes."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = self.kind[points]
        if (new := points[kinds < 0]).size:
            for point in np.unique(new).tolist():
                c = chr(point)
                self.kind[point] = _BLANK if c == " " else _OWN if c == SPACE else _ALPHA if re.match(_LETTER, c) else _OTHER
                if c == SPACE:  # a symbol that no pair has
                    self.symbol[point] = len(self.output)
                    self.output.append(tuple(self.bytes[b] for b in c.encode()))
                elif c == " ":
                    self.symbol[point] = self.single[SPACE]
                else:
                    self._character(c)
            kinds = self.kind[points]
        return self.symbol[points], kinds

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the pieces that pairs of symbols join to; where there is none, the largest number."""
        key = left.astype(np.int64) << 32 | right
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)
        held = self.slot[at]
        out = np.where(held == key, self.rank[at], _LAST >> _PLACES)
        more = np.flatnonzero((held != key) & (held >= 0))
        while more.size:
            at[more] = (at[more] + 1) & (len(self.slot) - 1)
            held = self.slot[at[more]]
            hit = held == key[more]
            out[more[hit]] = self.rank[at[more[hit]]]
            more = more[~hit & (held >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path(MODEL))


def skipped(key: int, place: int, piece: int, limit: int) -> bool:
    """Whether the keyed 32-bit hash of a candidate is below the limit."""
    x = (key ^ (place * 0x9E3779B1) ^ (piece * 0x85EBCA6B)) & _MASK
    x = ((x ^ (x >> 16)) * 0x7FEB352D) & _MASK
    x = ((x ^ (x >> 15)) * 0x846CA68B) & _MASK
    return (x ^ (x >> 16)) < limit


def merged(word: str, v: Vocabulary, key: int = 0, rate: float = 0.0) -> list[str]:
    """The symbols of one word after all merges, with the candidates in a heap; spaces are SPACE."""
    ids, scores, symbols, limit = v.ids, v.scores, list(word), int(rate * (1 << 32))
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = []
    for i in range(n - 1):
        joined = symbols[i] + symbols[i + 1]
        if joined in scores:
            agenda.append((-scores[joined], i, joined))
    heapify(agenda)
    while agenda:
        _, i, joined = heappop(agenda)
        j = after[i]
        if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(joined) or symbols[i] + symbols[j] != joined:
            continue
        if limit and skipped(key, i, ids[joined], limit):
            continue
        symbols[i], symbols[j] = joined, ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            new = joined + symbols[k]
            if new in scores:
                heappush(agenda, (-scores[new], i, new))
        h = before[i]
        if h >= 0:
            new = symbols[h] + joined
            if new in scores:
                heappush(agenda, (-scores[new], h, new))
    return [s for s in symbols if s]


def occurrence_keys(seed: int, text: str, first: int, n: int) -> np.ndarray:
    """32-bit keys for n words of a text from the first one on, from the seed, the whole text and the word's place."""
    start = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), zlib.crc32(str(seed).encode()))
    return _keys(np.full(n, start, dtype=np.uint64), np.arange(first, first + n, dtype=np.uint64))


def _keys(start: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = place * np.uint64(0x9E3779B97F4A7C15) + start
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


def run_starts(kinds: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where runs start: blanks go with what follows them; letters, other characters and each own U+2581 are apart. fresh: starts of texts."""
    before, now = kinds[:-1], kinds[1:]
    starts = np.ones(len(kinds), dtype=bool)
    starts[1:] = (now == _OWN) | (before == _OWN) | ((before != _BLANK) & (now != before))
    starts[fresh] = True
    return np.flatnonzero(starts)


class Encoder:
    """Encodes texts. Without a rate the ids are the model's own."""

    def __init__(self, v: Vocabulary, seed: int = SEED, rate: float = RATE):
        self.v, self.seed, self.rate, self.limit = v, seed, rate, int(rate * (1 << 32))

    def __call__(self, text: str) -> np.ndarray:
        return next(iter(self.encode([text])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian 32-bit numbers; an empty text has none."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        starts = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), zlib.crc32(str(self.seed).encode())) for t in texts]
        done = [0] * len(texts)  # runs so far
        held: list[tuple[int, str]] = []
        size = 0

        def work() -> None:
            for (i, _), (ids, runs) in zip(held, self._window([p for _, p in held], [starts[i] for i, _ in held], [done[i] for i, _ in held]), strict=True):
                out[i].append(ids)
                done[i] += runs
            held.clear()

        for i, text in enumerate(texts):
            for part in windows(text):
                if held and (size + len(part) > WINDOW or held[-1][0] == i):
                    work()
                    size = 0
                held.append((i, part))
                size += len(part)
        if held:
            work()
        return [np.concatenate(parts) if parts else np.zeros(0, dtype="<i4") for parts in out]

    def _window(self, parts: list[str], hashes: list[int], first: list[int]) -> Iterator[tuple[np.ndarray, int]]:
        """The ids and the number of runs of each part."""
        symbols, kinds = self.v.characters("".join(parts))
        fresh = np.cumsum([0, *map(len, parts)])
        starts = run_starts(kinds, fresh[:-1])
        lengths = np.diff(np.append(starts, len(kinds)))
        edges = np.searchsorted(starts, fresh)
        owner = np.repeat(np.arange(len(parts)), np.diff(edges))
        place = np.arange(len(starts)) - edges[owner] + np.array(first)[owner]
        keys = _keys(np.array(hashes, dtype=np.uint64)[owner], place.astype(np.uint64))

        counts, made, low = np.zeros(len(starts), dtype=np.int64), [], 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            for at in range(0, len(rows), RUNS):
                run = rows[at : at + RUNS]
                found = self._merge(symbols, starts[run], lengths[run], keys[run], width)
                where, values = self._ids(*found)
                counts[run] = np.bincount(where, minlength=len(run))
                made.append((run[where], values))
            low = width
        text = "".join(parts) if (lengths > WIDEST).any() else ""
        for r in np.flatnonzero(lengths > WIDEST).tolist():
            word = text[starts[r] : starts[r] + lengths[r]].replace(" ", SPACE)
            codes = [self.v.ids[s] if s in self.v.ids else self.v.single[s] for s in merged(word, self.v, int(keys[r]), self.rate)]
            _, values = self._ids(np.zeros(len(codes), dtype=np.int64), np.array(codes, dtype=np.int64))
            counts[r] = len(values)
            made.append((np.full(len(values), r), values))

        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<i4")
        for rows, values in made:  # a run's ids stand together
            n = counts[rows[np.flatnonzero(np.diff(rows, prepend=-1))]] if len(rows) else counts[:0]
            inside = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            out[ends[rows] - counts[rows] + inside] = values
        cuts = np.concatenate([[0], ends])[edges]
        for k in range(len(parts)):
            yield out[cuts[k] : cuts[k + 1]], int(edges[k + 1] - edges[k])

    def _merge(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All merges of runs of up to `width` symbols: the run of each symbol that is left, in order, and the symbol.

        Tables have a row for each place and one more, which stands for no neighbour, and a column for each run.
        """
        v, n = self.v, len(starts)
        places = np.arange(width + 1)[:, None]
        inside = places < lengths[None, :]
        sym = np.where(inside, symbols[np.minimum(starts[None, :] + places, len(symbols) - 1)], -1).astype(np.int64)
        after = np.where(places + 1 < lengths[None, :], places + 1, width)
        before = np.where(places > 0, places - 1, width) + np.zeros((1, n), dtype=np.int64)
        agenda = np.full((width + 1, n), _LAST, dtype=np.int32)
        both = np.flatnonzero(inside[1:].ravel())
        agenda.reshape(-1)[both] = self._entries(sym.reshape(-1)[both], sym.reshape(-1)[both + n], both // n)
        sym, after, before, flat = (x.reshape(-1) for x in (sym, after, before, agenda))
        cols = np.arange(n)
        none = width * n
        while cols.size:
            best = (agenda if cols.size == n else agenda[:, cols]).min(axis=0)
            live = best < _LAST
            if not live.all():
                cols, best = cols[live], best[live]
                if not cols.size:
                    break
            i = (best & ((1 << _PLACES) - 1)).astype(np.int64)
            joined = v.id_of_rank[best >> _PLACES]
            here = i * n + cols
            if self.limit:
                x = keys[cols] ^ (i.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (joined.astype(np.uint32) * np.uint32(0x85EBCA6B))
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
                take = (x ^ (x >> np.uint32(16))).astype(np.int64) >= self.limit
                flat[here[~take]] = _LAST
                here, i, joined, c = here[take], i[take], joined[take], cols[take]
            else:
                c = cols
            j = after[here]
            there = j * n + c
            k = after[there]
            next_, h = k * n + c, before[here]
            last = h * n + c
            sym[here], sym[there], flat[there] = joined, -1, _LAST
            after[here], before[next_] = k, i
            flat[here] = self._entries(joined, sym[next_], i)
            flat[last] = self._entries(sym[last], joined, h)
            flat[none:] = _LAST
        left = sym[:none].reshape(width, n).T
        rows, at = np.nonzero(left >= 0)
        return rows, left[rows, at]

    def _entries(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Agenda entries of pairs: rank, then place; the largest number where a pair joins to nothing or one is missing."""
        rank = self.v.joined(np.maximum(left, 0), np.maximum(right, 0))
        bad = (left < 0) | (right < 0) | (rank == _LAST >> _PLACES)
        return np.where(bad, _LAST, rank << _PLACES | place.astype(np.int32))

    def _ids(self, rows: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, each with its symbol's row: a piece has one, other characters one for each byte."""
        odd = symbols >= len(self.v.pieces)
        if not odd.any():
            return rows, symbols
        own = {s: self.v.output[s] for s in np.unique(symbols[odd]).tolist()}
        n = np.ones(len(symbols), dtype=np.int64)
        n[odd] = [len(own[s]) for s in symbols[odd].tolist()]
        values = np.repeat(symbols, n)
        values[np.repeat(odd, n)] = [b for s in symbols[odd].tolist() for b in own[s]]
        return np.repeat(rows, n), values


def windows(text: str) -> Iterator[str]:
    """The text, a space put before it, in parts of about WINDOW characters that end where a run does."""
    text, at = f" {text}" if text else "", 0
    while at < len(text):
        cut = _NEW_WORD.search(text, at + WINDOW) if at + WINDOW < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def decode(ids: np.ndarray | list[int], v: Vocabulary) -> str:
    """The text of the ids: pieces and bytes joined, spaces back, without the space put before the text."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    return b"".join(map(v.texts.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def encode_texts(docs: DataFrame, seed: int = SEED, rate: float = RATE, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null or empty text has no ids."""

    def work(rows: pa.RecordBatch) -> dict:
        ids = Encoder(vocabulary(path), seed, rate).encode([t or "" for t in rows.column("text").to_pylist()])
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return {"doc_id": rows.column("doc_id"), "ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))}

    return map_rows(_texts(docs), "text", "doc_id long, ids array<int>", work)


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of encode_texts(); null ids have a null text."""

    def work(rows: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        return {"doc_id": rows.column("doc_id"), "text": [None if i is None else decode(i, v) for i in rows.column("ids").to_pylist()]}

    return map_rows(encoded.selectExpr("doc_id", "ids", "'' AS text"), "text", "doc_id long, text string", work)


def round_trip(docs: DataFrame, seed: int = SEED, rate: float = RATE, path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_pieces, ids_crc32 (unsigned, of little-endian 32-bit ids) and lossless.

    lossless says that the decoded ids are the text. A null text counts as empty and has no pieces. Null doc_ids stay
    null; equal texts have equal ids, repeated rows are encoded each, and an empty table gives an empty result. Further
    columns are ignored.
    """

    def work(rows: pa.RecordBatch) -> dict:
        v, texts = vocabulary(path), [t or "" for t in rows.column("text").to_pylist()]
        ids = Encoder(v, seed, rate).encode(texts)
        lossless = [decode(i, v) == t for i, t in zip(ids, texts, strict=True)]
        return {"doc_id": rows.column("doc_id"), "n_pieces": list(map(len, ids)), "ids_crc32": [zlib.crc32(i) for i in ids], "lossless": lossless}

    return map_rows(_texts(docs), "text", "doc_id long, n_pieces long, ids_crc32 long, lossless boolean", work)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
