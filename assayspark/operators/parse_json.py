"""JSON documents to tables. Keys may repeat in them, which Spark's JSON functions lose, so a small helper lists their parts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import results_file
from assayspark.model import DATA_SECTIONS, PAIRS, TABLES, Tables, stored

ROWS = "array<struct<row:int,cells:array<struct<pos:int,value:string,raw:boolean>>>>"
PART = f"file_id string, kind string, section string, tbl string, row int, pos int, key string, value string, raw boolean, factors {PAIRS}, additional {PAIRS}"
#: Of a table: its columns, whether it stands in one place of the document, and its rows.
TABLE = f"{PART}, names array<string>, dups array<int>, alone boolean, rows {ROWS}"
COLUMNS = "file_id kind section tbl row pos key value raw factors additional names dups alone rows".split()
#: Cells and letters of documents that are handed on at once.
BATCH_CELLS, BATCH_LETTERS = 500_000, 16_000_000
_RESULTS = ("filename", "UNITS", "Has m/z", "Has RT", "RT units")


class Pairs(list):
    """The (key, value) pairs of a JSON object in order, repeats and all."""

    def numbered(self) -> Iterator[tuple[str, object, int]]:
        seen: dict[str, int] = {}
        for key, value in self:
            yield key, value, seen.get(key, 0)
            seen[key] = seen.get(key, 0) + 1


def _text(value: object) -> str:
    """JSON text of a parsed value; keys that repeat stay."""
    if isinstance(value, Pairs):
        return "{" + ", ".join(f"{json.dumps(k)}: {_text(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_text, value)) + "]"
    return json.dumps(value)


def plain(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else _text(value)


def raw(value: object) -> bool:
    return not isinstance(value, str) and value is not None


_BIN = "Bin range(ppm)"
Column_ = str | tuple[str, int]  # a name, or one that stands in the row before, with the number of times


class Table:
    """A table's columns and rows while they are read. Its columns are the union of those of its rows: the name of the metabolite first, then in the
    order in which they first turn up; each has one place."""

    def __init__(self, section: str):
        self.section, self.alone, self.rows = section, True, []
        self.first: dict[Column_, tuple[int, int]] = {}

    def add(self, section: str, rows: list[Pairs]) -> None:
        first, once = self.first, not self.rows
        self.alone, self.section = self.alone and once, min(self.section, section)
        for r, row in enumerate(rows):
            own = [k for k, _ in row]
            if len(set(own)) < len(own):
                own = [(k, dup) if dup else k for k, _, dup in row.numbered()]
            if _BIN in own:
                own = ["Metabolite" if c == _BIN else c for c in own]
            for at, c in enumerate(own):
                if c not in first or not once and (r, at) < first[c]:
                    first[c] = r, at
            self.rows.append((r, own, [v for _, v in row]))

    def columns(self) -> list[Column_]:
        return sorted(self.first, key=lambda c: (c != "Metabolite", self.first[c]))

    def names(self) -> tuple[list[str], list[int]]:
        """The columns' names and the numbers of equal names before them in a row."""
        columns = [c if isinstance(c, tuple) else (c, 0) for c in self.columns()]
        return [c for c, _ in columns], [d for _, d in columns]


def parts(text: str, force: bool) -> tuple[list[tuple], dict[str, Table]]:
    """The parts of one document beside its tables, (kind, section, tbl, row, pos, key, value, raw, factors, additional), and its tables by name."""
    top = json.loads(text, object_pairs_hook=Pairs)
    if not isinstance(top, Pairs):
        raise TypeError("Expected an object at the top of the document.")
    if len({k for k, _ in top}) < len(top):
        raise KeyError("A section is given more than once.")
    out: list[tuple] = []
    blocks: list[tuple] = []
    tables: dict[str, Table] = {}
    cells = 0  # which places of items count

    def pairs(value: object) -> list[dict]:
        return [{"key": k, "value": plain(v), "dup": d} for k, v, d in value.numbered()] if isinstance(value, Pairs) else []

    for section, body in top:
        if section == "SUBJECT_SAMPLE_FACTORS" and not isinstance(body, Pairs):
            for i, sample in enumerate(body or []):
                held = dict(sample)
                out.append(("ssf", section, None, i, None, held.get("Subject ID"), held.get("Sample ID"), False, pairs(held.get("Factors")), pairs(held.get("Additional sample data"))))
            continue
        if not isinstance(body, Pairs):
            raise TypeError(f"Expected an object in section {section}.")
        for key, value, _ in body.numbered():
            if key in TABLES and isinstance(value, list) and not isinstance(value, Pairs):
                bad = [i for i, row in enumerate(value) if not isinstance(row, Pairs)]
                if bad and not force:
                    raise TypeError(f"Rows that are no objects in {section} {key}: {bad}")
                rows = [row for row in value if isinstance(row, Pairs)]
                cells += sum(map(len, rows))
                if any(rows):
                    blocks.append(("block", section, key, None, None, None, None, False, [], []))
                    tables.setdefault(key, Table(section)).add(section, rows)
            elif key.endswith("_RESULTS_FILE"):
                held = dict(value) if isinstance(value, Pairs) else None
                line = value if held is None else "".join(f"{held[k]}" if k == "filename" else f"\t{k}:{held[k]}" for k in _RESULTS if k in held)
                out.append(("results", section, None, None, None, key, line, False, [], []))
            else:
                out.append(("item", section, None, None, len(out) + cells, key, plain(value), raw(value), [], []))
    return out + blocks, tables


def _arrow(found: list[tuple[str, list[tuple], dict[str, Table]]]) -> pa.RecordBatch:
    """Documents' parts and tables as rows of TABLE. Cells are put together as flat lists, as there may be many of them."""
    pairs = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string()), ("dup", pa.int32())]))
    kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.bool_(), pairs, pairs]
    rows: list[tuple] = [(file_id, *x) for file_id, out, _ in found for x in out]
    tables = [(file_id, name, t) for file_id, _, held in found for name, t in held.items()]
    none = [None] * len(rows)
    rows += [(file_id, "table", t.section, name, None, None, None, None, False, [], []) for file_id, name, t in tables]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    rows_end, cells_end, row, pos, values = [0] * (len(none) + 1), [0], [], [], []
    for *_, t in tables:
        place = {c: i for i, c in enumerate(t.columns())}
        for r, own, cells in t.rows:
            row.append(r)
            pos.extend([place[c] for c in own])
            values.extend(cells)
            cells_end.append(len(values))
        rows_end.append(len(row))
    if set(map(type, values)) <= {str, type(None)}:
        other = np.zeros(len(values), bool)
    else:
        other, values = list(map(raw, values)), list(map(plain, values))
    cells = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(values, pa.string()), pa.array(other, pa.bool_())], ["pos", "value", "raw"])
    held = pa.StructArray.from_arrays([pa.array(row, pa.int32()), pa.ListArray.from_arrays(pa.array(cells_end, pa.int32()), cells)], ["row", "cells"])
    headers = [t.names() for *_, t in tables]
    arrays += [pa.array(none + [h[i] for h in headers], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int32()))]
    arrays += [pa.array(none + [t.alone for *_, t in tables], pa.bool_()), pa.ListArray.from_arrays(pa.array(rows_end, pa.int32()), held)]
    return pa.RecordBatch.from_arrays(arrays, names=COLUMNS)


def json_tables(documents: DataFrame, force: bool = False) -> Tables:
    """All tables of those of documents(file_id, text, error) that are JSON; force: rows that are no objects are left out. The
    documents' parts are listed once and written to the shared folder, a table as one row; cells follow from it without a shuffle."""
    documents = documents.filter(F.col("error").isNull() & is_json(F.col("text")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, list[tuple], dict[str, Table]]] = []
            cells = letters = 0
            for file_id, text in zip(batch["file_id"], batch["text"], strict=True):
                file_id, text = file_id.as_py(), text.as_py()
                try:
                    out, tables = parts(text, force)
                except (ValueError, TypeError, KeyError, AttributeError) as error:
                    out, tables = [("error", None, None, None, None, None, f"{type(error).__name__}: {error}", False, [], [])], {}
                found.append((file_id, out, tables))
                cells += sum(len(own) for t in tables.values() for _, own, _ in t.rows)
                letters += len(text)
                if cells >= BATCH_CELLS or letters >= BATCH_LETTERS:
                    yield _arrow(found)
                    found, cells, letters = [], 0, 0
            yield _arrow(found)

    rows = stored(documents.select("file_id", "text").mapInArrow(listed, TABLE), "parts")
    documents = documents.select("file_id")
    of = lambda kind: rows.filter(F.col("kind") == kind)
    data = rows.filter(F.col("section").isin(*DATA_SECTIONS)).groupBy("file_id").agg(F.min("section").alias("data_section"))
    errors = of("error").groupBy("file_id").agg(F.min("value").alias("error"))
    files = documents.select("file_id", F.lit("json").alias("input_format")).join(data, "file_id", "left").join(errors, "file_id", "left")
    files = files.select("file_id", "input_format", "data_section", "error")
    items = of("item").select("file_id", "section", F.col("pos").alias("ord"), "key", "value", F.lit(False).alias("repeated"), "raw")
    ssf = of("ssf").select("file_id", F.col("row").alias("idx"), F.col("key").alias("subject_id"), F.col("value").alias("sample_id"), "factors", "additional")
    tables = of("table").select("file_id", "tbl", "names", "dups", "alone", "rows")
    headers = tables.select("file_id", "tbl", "dups", F.posexplode("names").alias("pos", "column"))
    headers = headers.select("file_id", "tbl", "pos", F.col("column").alias("raw"), "column", F.get("dups", F.col("pos")).alias("dup"), F.lit(True).alias("named"))
    blocks = of("block").select("file_id", "section", "tbl", F.lit(False).alias("overflow")).distinct()
    factors = of("none").select("file_id", F.col("key").alias("sample_id"), F.col("pos").alias("ord"), "key", "value")
    results = of("results").select("file_id", "section", results_file(F.col("value")).alias("r")).select("file_id", "section", "r.*")
    lists = tables.filter("alone").select("file_id", "tbl", "names", "rows")
    return Tables(files, items, ssf, headers, _cells_of(tables), factors, blocks, results).with_lists(lists, _cells_of(tables.filter("NOT alone")))


def _cells_of(tables: DataFrame) -> DataFrame:
    """The cells of tables(file_id, tbl, names, dups, rows), as in Tables. Rows may lack columns and have them in an order of their own."""
    rows = tables.select("file_id", "tbl", "names", "dups", F.inline("rows"))
    cells = rows.select("file_id", "tbl", "row", "names", "dups", F.posexplode("cells").alias("at", "x")).select("*", "x.*")
    return cells.select("file_id", "tbl", "row", "pos", "at", F.get("names", F.col("pos")).alias("column"), F.get("dups", F.col("pos")).alias("dup"), "value", "raw")


def is_json(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\s*\{"))
