"""The rows of one table of one document, as they come: what the data source and the table function read with. A helper of plain
Python for documents one at a time; whole collections are parsed by the plans of operators/parse_text.py, with the same results."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from assayspark.model import DATA_SECTIONS, HEADER, MARKER, PAIRS

#: Columns of each table behind file_id, as in model.Tables.
SCHEMAS = {
    "items": "section string, ord int, key string, value string, repeated boolean, raw boolean",
    "ssf": f"idx int, subject_id string, sample_id string, factors {PAIRS}, additional {PAIRS}",
    "cells": "tbl string, row int, pos int, at int, column string, dup int, value string, raw boolean",
}
#: What can be read: these tables, and the cells that are not empty, each beside the metabolite of its row.
READ = SCHEMAS | {"values": "tbl string, row int, metabolite string, column string, dup int, value string"}
_SAMPLES = "SUBJECT_SAMPLE_FACTORS"


_LINE, _EDGE = re.compile(r"[^\r\n]+"), re.compile(r"_(?:START|END)(?=[\r\n]|\Z)")


def _lines(text: str, rows: bool = True) -> Iterator[tuple[str, str, int, int, str]]:
    """kind, section, block's number, place in it and line; kind is row, header, section, ssf, edge, results or item. rows=False: tables'
    rows are passed over."""
    section, block_name, block, place, at = None, "", 0, 0, 0
    while found := _LINE.search(text, at):
        line, at = found[0], found.end()
        starts = line.endswith("_START")
        if starts:
            block_name, block, place = line[:-6], block + 1, 0
        elif line.endswith("_END"):
            block_name = ""
        inside = block_name != "" and not starts
        if line.startswith("#") and not inside:
            name = HEADER if line.startswith(MARKER) else _SAMPLES if line.startswith(f"#{_SAMPLES}:") else line[1:].strip(" ")
            section = "NM" if name == "NMR" else name
        kind = (
            "row" if inside else "header" if line.startswith(MARKER) else "section" if line.startswith("#") else "ssf" if line.startswith(_SAMPLES)
            else "edge" if starts or line.endswith("_END") else "results" if "_RESULTS_FILE" in line else "item"
        )
        yield kind, section, block_name if inside else "", place, line
        place += inside
        if block_name and not rows:
            edge = _EDGE.search(text, at)
            at = max(text.rfind(end, at, edge.start()) for end in "\r\n") + 1 if edge else len(text)


def _numbered(pairs: list[tuple[str, str]]) -> list[dict]:
    seen: dict = {}
    out = []
    for key, value in pairs:
        out.append({"key": key, "value": value, "dup": seen.get(key, 0)})
        seen[key] = seen.get(key, 0) + 1
    return out


def _pairs(text: str, sign: str, bar: str) -> list[dict]:
    """`key<sign>value<bar>key<sign>value`, both stripped."""
    parts = text.split(sign)
    keys = [parts[0], *(p.rsplit(bar, 1)[-1] if bar in p else None for p in parts[1:-1])]
    return _numbered([(k and k.strip(" "), p.rsplit(bar, 1)[0].strip(" ")) for k, p in zip(keys, parts[1:], strict=True)]) if len(parts) > 1 else []


def _items(text: str, data: str | None, only: str | None) -> Iterator[tuple]:
    held: dict[tuple, list] = {}
    for kind, section, _, _, line in _lines(text, rows=False):
        section = data if section == "METABOLITES" else section
        if section is None or kind not in ("header", "item") or only not in (None, section):
            continue
        if kind == "header":
            parts = [w.split(":") for w in re.split("[ \t]", line) if ":" in w]
            new = [(p[0], p[1]) for p in parts if len(p) == 2]
        else:
            k, tab, v = line.partition("\t")
            coded = ":" in k
            new = [("Units" if ":UNITS" in k else k.strip(" ")[3:], v) if coded else (k.strip(" "), v.strip(" "))] if tab else []
        for key, value in new:
            x = held.get((section, key))
            if x is None:
                held[section, key] = [value, False]
            else:
                x[1] |= x[0] == value
                x[0] = value if section == HEADER else f"{x[0]} {value}"
    places: dict[str, int] = {}
    for (section, key), (value, repeated) in held.items():
        places[section] = places.get(section, -1) + 1
        yield section, places[section], key, value, repeated, False


def _ssf(text: str) -> Iterator[tuple]:
    n = 0
    for kind, section, _, _, line in _lines(text, rows=False):
        if kind == "ssf" and section is not None:
            parts = [*line.split("\t"), None, None, None, None][: max(5, line.count("\t") + 1)]
            yield n, parts[1], parts[2], _pairs(parts[3], ":", "| ") if parts[3] is not None else [], _pairs(parts[4] or "", "=", "; ")
            n += 1


def _is_header(tokens: list[str], place: int, block: str, samples: set) -> bool:
    first, extended, measured = tokens[0] if tokens else None, "EXTENDED" in block, "METABOLITE_DATA" in block
    if place >= 2 or first is None:
        return False
    if "BINNED_DATA" in block and not extended:
        return first == "Bin range(ppm)"
    if first == "Factors" and measured:
        return True
    if measured and not extended:
        return not samples.isdisjoint(tokens[1:]) or (first in ("Samples", "metabolite name", "metabolite_name") and (len(tokens) == 1 or not samples))
    return first.lower() == "metabolite_name"


def _rows(text: str, data: str | None, only: str | None) -> Iterator[tuple]:
    """tbl, row, names, dups and tokens of the rows of tables."""
    samples, rows, names, dups = {s[2] for s in _ssf(text) if s[2] is not None}, {}, [], []
    for kind, section, block, place, line in _lines(text):
        if kind != "row" or (data if section == "METABOLITES" else section) is None:
            continue
        tbl = "Metabolites" if block == "METABOLITES" else "Extended" if block.startswith("EXTENDED_") else "Data"
        if only not in (None, tbl):
            continue
        tokens = [x.strip('" ') for x in line.split("\t")]
        while tokens and not tokens[-1]:
            tokens.pop()
        if place == 0:
            names, seen = ["Metabolite", *tokens[1:]], {}
            dups = []
            for c in names:
                dups.append(seen.get(c, 0))
                seen[c] = seen.get(c, 0) + 1
        if not _is_header(tokens, place, block, samples):
            row = rows[tbl] = rows.get(tbl, -1) + 1
            yield tbl, row, names, dups, tokens


def _cells(text: str, data: str | None, only: str | None) -> Iterator[tuple]:
    for tbl, row, names, dups, tokens in _rows(text, data, only):
        for pos in range(max(len(names), len(tokens))):
            known = pos < len(names)
            yield tbl, row, pos, pos, names[pos] if known else "", dups[pos] if known else pos - len(names), tokens[pos] if pos < len(tokens) else "", False


def _values(text: str, data: str | None, only: str | None) -> Iterator[tuple]:
    """Of text documents, whose rows begin with the metabolite."""
    for tbl, row, names, dups, tokens in _rows(text, data, only):
        metabolite = tokens[0] if tokens else ""
        for pos in range(1, len(tokens)):
            if value := tokens[pos]:
                known = pos < len(names)
                yield tbl, row, metabolite, names[pos] if known else "", dups[pos] if known else pos - len(names), value


def _values_of_cells(cells: Iterator[tuple]) -> Iterator[tuple]:
    for (tbl, row), held in groupby(cells, lambda c: c[:2]):
        held = list(held)
        for name in (c[6] for c in held if c[4] == "Metabolite" and c[5] == 0):
            yield from ((tbl, row, name, column, dup, value) for _, _, _, _, column, dup, value, _ in held if value and (column, dup) != ("Metabolite", 0))


def _of_json(text: str, table: str, section: str | None, tbl: str | None) -> Iterator[tuple]:
    from assayspark.operators.parse_json import parts, plain, raw

    found, tables = parts(text, False)
    if table == "items":
        yield from ((s, pos, key, value, False, other) for kind, s, _, _, pos, key, value, other, _, _ in found if kind == "item" and section in (None, s))
    elif table == "ssf":
        yield from ((row, key, value, factors, additional) for kind, _, _, row, _, key, value, _, factors, additional in found if kind == "ssf")
    else:
        for name, t in ((name, t) for name, t in tables.items() if tbl in (None, name)):
            place = {c: (i, *x) for i, (c, *x) in enumerate(zip(t.columns(), *t.names(), strict=True))}
            for row, own, values in t.rows:
                for at, (c, v) in enumerate(zip(own, values, strict=True)):
                    pos, column, dup = place[c]
                    yield name, row, pos, at, column, dup, plain(v), raw(v)


def rows_of(text: str, table: str, section: str | None = None, tbl: str | None = None) -> Iterator[tuple]:
    """The rows of a table of READ of one document, of one section or block only where one is named. A document of neither form has none."""
    if text.lstrip().startswith("{"):
        yield from _values_of_cells(_of_json(text, "cells", section, tbl)) if table == "values" else _of_json(text, table, section, tbl)
    elif text.lstrip("\r\n").startswith(MARKER):
        data = next((s for kind, s, *_ in _lines(text, rows=False) if s in DATA_SECTIONS), None)
        yield from _items(text, data, section) if table == "items" else _ssf(text) if table == "ssf" else _values(text, data, tbl) if table == "values" else _cells(text, data, tbl)


def holds(text: str, section: str, key: str, value: str) -> bool:
    """Whether an item of the document has the value; one that can't be read has none."""
    try:
        return any((k, v) == (key, value) for s, _, k, v, *_ in rows_of(text, "items", section) if s == section)
    except (ValueError, TypeError, KeyError, AttributeError):
        return False
