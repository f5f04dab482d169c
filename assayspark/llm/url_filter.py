"""URL rules as a sorted array of 64-bit digests, memory-mapped in each task and probed by binary search.

A rule is an action, a host and a path: it fits its host and all subdomains when the URL's path starts with the rule's.
The array holds the xxhash of each rule's string (host and path), sorted; a probe that hits is confirmed against the
stored string, so colliding digests change nothing. A URL probes its host's suffixes of as many labels as rules' hosts
have, with the path prefixes of those lengths that rules have. Of fitting rules, the longest (host and path together) wins.

Rules can be a table of any size: each pass over the URLs sends one array of at most ARRAY_RULES rules, and takes it back
before the next one is sent.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.llm.shared import Scratch, map_rows

#: (action, host, path). Fixed values of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: What the method blocks where no rule fits.
SITES = (("block", "spam-farm.example.com", "/"), ("block", "spam-farm.example.net", "/"), ("block", "spam-farm.example.org", "/"))
#: Rules in what is sent to all executors at once (64 MB at most with strings of 240 bytes); more rules make more passes.
ARRAY_RULES = 250_000
Rule = tuple[str, str, str]


def _length(host: bytes, path: bytes, action: str) -> tuple[int, int, bool]:
    """Of host and path together, in code points; of equal ones, the longer host counts as longer, and then block."""
    return len(host.decode()) + len(path.decode(errors="replace")), len(host), action == "block"


class DigestArray:
    """Sorted digests over stored strings; find() gives the stored row of each probe or -1."""

    def __init__(self, rules: Iterable[Rule]):
        rules = sorted(set(rules), key=lambda r: (r[1], r[2], r[0] != "block"))
        texts: dict[tuple[bytes, bytes], str] = {}
        for action, host, path in rules:
            texts.setdefault((host.encode(), path.encode()), action)
        digests = np.array([self.digest(h + p) for h, p in texts], dtype=np.uint64)
        order = np.argsort(digests, kind="stable")
        stored = list(texts)
        self.stored = [(*stored[i], texts[stored[i]]) for i in order]
        self.lengths = sorted({len(p) for _, p in stored})
        self.labels = sorted({h.count(b".") + 1 for h, _ in stored})
        self.bytes: bytes | None = digests[order].tobytes()
        self._mapped: np.ndarray | None = None

    digest = staticmethod(xxhash.xxh64_intdigest)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_mapped": None, "bytes": self.mapped().tobytes()}

    def mapped(self) -> np.ndarray:
        """The array, mapped from a file of this process that has no name any more and goes with it."""
        if self._mapped is None:
            if not self.bytes:
                self._mapped = np.zeros(0, dtype=np.uint64)
            else:
                with tempfile.TemporaryFile() as file:
                    file.write(self.bytes)
                    file.flush()
                    self._mapped = np.memmap(file, dtype=np.uint64, mode="r")
            self.bytes = None
        return self._mapped

    def find(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """The stored row for each host and path prefix, or -1; only probes whose digest is there look at strings."""
        keys = np.fromiter(map(self.digest, map(bytes.__add__, hosts, paths)), dtype=np.uint64, count=len(hosts))
        array = self.mapped()
        rows = np.full(len(keys), -1, dtype=np.int64)
        if not len(array):
            return rows
        at = np.searchsorted(array, keys)
        for i in np.flatnonzero(array[np.minimum(at, len(array) - 1)] == keys).tolist():
            j = int(at[i])
            while j < len(array) and array[j] == keys[i]:  # equal digests stand side by side
                if self.stored[j][:2] == (hosts[i], paths[i]):
                    rows[i] = j
                    break
                j += 1
        return rows

    def longest(self, urls: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes, str] | None]:
        """The longest fitting rule of each (host, path)."""
        owners, hosts, paths = [], [], []
        most = self.labels[-1] if self.labels else 0
        for i, (host, path) in enumerate(urls):
            ends = host.rsplit(b".", most) if host and most else []
            count = host.count(b".") + 1
            for n in self.labels:
                if n > count or not ends:
                    break
                suffix = host if n == count else b".".join(ends[-n:])
                for k in self.lengths:
                    if k > len(path):
                        break
                    owners.append(i)
                    hosts.append(suffix)
                    paths.append(path[:k])
        best: list[tuple[bytes, bytes, str] | None] = [None] * len(urls)
        for i, row in zip(owners, self.find(hosts, paths).tolist(), strict=True):
            if row >= 0 and (best[i] is None or _length(*self.stored[row]) > _length(*best[i])):
                best[i] = self.stored[row]
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def _passes(rules: Iterable[Rule] | DataFrame, sites: Iterable[Rule] | DataFrame) -> Iterator[dict[str, DigestArray]]:
    """Arrays for what is sent at once, by kind. A table of rules comes to the driver part by part; rows with nulls are left out."""

    def each(kind: str, given: Iterable[Rule] | DataFrame) -> Iterator[tuple[str, Rule]]:
        if isinstance(given, DataFrame):
            given = map(tuple, given.select("action", "host", "path").dropna().distinct().toLocalIterator())
        return ((kind, rule) for rule in given)

    stream = (x for kind, given in (("rule", rules), ("site", sites)) for x in each(kind, given))
    while held := list(islice(stream, ARRAY_RULES)):
        yield {kind: DigestArray(r for _, r in part) for kind, part in groupby(held, key=lambda x: x[0])}


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame = RULES, sites: Iterable[Rule] | DataFrame = SITES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Rules and sites are triples, or tables, of action, host and path. rule is the string of the longest fitting rule (host
    and path) or null; verdict is its action, block where it has both. Where none fits, `sites` decide in the same way,
    and what they don't name is allowed. A null URL, or one without `://`, has an empty host and path and is allowed.
    Repeated rows are judged each; an empty table gives an empty result; further columns are ignored. Rules beyond
    ARRAY_RULES are searched in passes that are written one after the other, so what is sent at once is bounded.
    """
    scratch = Scratch(pages.sparkSession)

    def split(rows: pa.RecordBatch) -> dict:
        hosts, paths = zip(*map(split_url, rows.column(1).to_pylist()), strict=True) if rows.num_rows else ((), ())
        none = [None] * rows.num_rows
        return {"page_id": rows.column(0), "host": list(hosts), "path": list(paths), "rule": none, "site": none}

    schema = "page_id long, host string, path string, rule struct<host:string,path:string,action:string>, site struct<host:string,path:string,action:string>"
    out = map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), "url", schema, split)
    sent = None
    for n, arrays in enumerate(_passes(rules, sites)):
        if sent is not None:
            out = scratch.keep(out, f"pass-{n}")
            sent.destroy()
            if n > 1:
                scratch.drop(f"pass-{n - 1}")
        sent = pages.sparkSession.sparkContext.broadcast(arrays)

        def probe(rows: pa.RecordBatch, sent=sent) -> dict:
            new = {f: rows.column(f) for f in rows.schema.names}
            urls = [(h.encode(), p.encode()) for h, p in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True)]
            for kind, array in sent.value.items():
                best = rows.column(kind).to_pylist()
                for i, hit in enumerate(array.longest(urls)):
                    if hit and (best[i] is None or _length(*hit) > _length(best[i]["host"].encode(), best[i]["path"].encode(), best[i]["action"])):
                        best[i] = {"host": hit[0].decode(), "path": hit[1].decode(), "action": hit[2]}
                new[kind] = best
            return new

        out = map_rows(out, "path", schema, probe)
    return out.select("page_id", "host", "path", F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.action", "site.action", F.lit("allow")).alias("verdict"))
