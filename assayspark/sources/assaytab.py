"""The data source `assaytab`: documents in files and archives, read in tasks of about equal bytes, and written all or not at all.

    spark.dataSource.register(AssayTab)
    spark.read.format("assaytab").option("table", "cells").load("folder")       # documents, items, ssf, cells or values
    texts.write.format("assaytab").option("archive", "zip").mode("overwrite").save("all.zip")

Reading. A zip archive's central directory and a tar archive's chain of headers are passed through first, in pieces, and dealt to tasks as whole files
are: a task is given a part of the directory or chain, and finds its members there. So one archive is read by many tasks and neither it nor its
members' names are ever held as a whole. Compressed tar archives are streams, each one task's.
Options file_id, and section (of items) or tbl (of cells), choose by a value: files are left unread and lines unparsed. Option where
(`SU:SUBJECT_TYPE=Human`) gives only documents of which an item has the value.
With option filters=true they follow from the query's own filters, for which Spark needs spark.sql.python.filterPushdown.enabled.

Writing. Tasks write below a hidden folder beside the result; what is committed is moved into place, and a job that fails leaves nothing. For one
archive of all documents, tasks write its members as they stand in it, deflated already; offsets follow from a running sum of the parts'
sizes, and the directory of the archive is put together last, part by part. The parts are then strung together as bytes, in pieces.

Files are reached through Arrow's file systems (local and shared folders, HDFS and object stores).
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from assayspark.functions.one_document import READ, holds, rows_of
from assayspark.operators.extract import SECTIONS
from assayspark.sources.files import READ_IN_FOLDERS

DOCUMENTS = "text string, error string"
PARTITION_BYTES = 32_000_000
PIECE = 8_000_000
EACH = 1000  # bytes that opening a document is held to cost
BATCH_ROWS, BATCH_BYTES = 20_000, 8_000_000
STREAMS = (".tar.gz", ".tar.bz2")
ARCHIVES = ("zip", "tar", "tar.gz", "tar.bz2")
_PACK = {"tar.gz": gzip.compress, "tar.bz2": bz2.compress}


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:(?=/(?!//))", "", path))


@dataclass(frozen=True)
class Unit:
    """What one task reads in one go: a file, or members of an archive that follow each other in its index (a zip archive's directory, a
    tar archive's chain of headers)."""

    path: str
    name: str  # file_id; of several members, the archive's
    kind: str  # file, stream, zip or tar
    size: int = 0  # in the file
    at: int = 0  # the part of the index that the members stand in
    length: int = 0
    shift: int = 0  # what stands in front of a zip archive
    headers: tuple[tuple[str, str], ...] = ()  # a tar archive's own up to here

    def goes_on_with(self, other: Unit) -> bool:
        return self.kind in ("zip", "tar") and (self.path, self.kind, self.at + self.length) == (other.path, other.kind, other.at)


@dataclass
class Units(InputPartition):
    units: list[Unit]


def units_of(path: str, most: int = 0) -> Iterator[Unit]:
    """The units of a file, an archive (each of its members), or a folder at any depth. Indexes of archives are passed through in pieces. most: members
    of a zip archive are one unit up to about so many bytes, without their names."""
    fs, top = opened(path)
    info = fs.get_file_info(top)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        found = [info]
    else:
        found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True)) if f.is_file and re.search(READ_IN_FOLDERS, f.path) and "/." not in f.path[len(top) :]]
    for f in sorted(found, key=lambda f: f.path):
        name = path if info.is_file else path.rstrip("/") + f.path[len(top.rstrip("/")) :]
        if f.path.endswith(".zip"):
            with fs.open_input_file(f.path) as file:
                yield from _zip_members(file, name, most)
        elif f.path.endswith(".tar"):
            with fs.open_input_file(f.path) as file, tarfile.open(fileobj=file, mode="r:") as archive:
                start, headers = 0, ()
                for m in archive:
                    archive.members = []  # else all of them stay in memory
                    if m.isfile():
                        yield Unit(name, f"{name}/{m.name}", "tar", m.size, start, archive.offset - start, 0, headers)
                        start, headers = archive.offset, tuple(archive.pax_headers.items())
        else:
            yield Unit(name, name, "stream" if f.path.endswith(STREAMS) else "file", f.size)


_END, _END_64, _IN_DIRECTORY = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4s6H3I3H")


def _zip_directory(file: pa.NativeFile) -> tuple[int, int, int]:
    """Where a zip archive's directory begins and ends in the file, and what stands in front of the archive."""
    whole = file.size()
    first = max(0, whole - _END.size - 0xFFFF)
    file.seek(first)
    tail = file.read()
    plain = tail[-_END.size :]  # without a comment
    at = len(tail) - _END.size if plain.startswith(b"PK\5\6") and plain.endswith(b"\0\0") else tail.rfind(b"PK\5\6")
    if not 0 <= at <= len(tail) - _END.size:
        raise zipfile.BadZipFile(f"No zip archive: {whole} bytes")
    size, offset = _END.unpack_from(tail, at)[5:7]
    end, far = first + at, _END_64.size + 20  # the record for large archives and its locator
    if end >= far:
        file.seek(end - far)
        record = file.read(far)
        if record.startswith(b"PK\6\6") and record[_END_64.size :].startswith(b"PK\6\7"):
            size, offset = _END_64.unpack_from(record)[8:10]
            end -= far
    return end - size, end, end - size - offset


def _zip_entries(directory: bytes) -> list[zipfile.ZipInfo]:
    """The entries of a part of a directory, read as the directory of an archive of its own."""
    with zipfile.ZipFile(io.BytesIO(directory + _zip_end(0, len(directory), 0))) as archive:
        return archive.infolist()


def _zip_members(file: pa.NativeFile, name: str, most: int) -> Iterator[Unit]:
    start, end, shift = _zip_directory(file)
    file.seek(start)
    held, at, here = b"", 0, start  # a piece of the directory, the place in it, and that of the piece in the file
    size = 0
    while here + at < end:
        if len(held) - at < 4 * 0x10000 and here + len(held) < end:  # an entry has at most three parts of 64 KB behind its head
            here, held, at = here + at, held[at:] + file.read(min(PIECE, end - here - len(held))), 0
        sign, _, _, flags, *_, packed, _, called, extra, comment = _IN_DIRECTORY.unpack_from(held, at)
        if sign != b"PK\1\2":
            raise zipfile.BadZipFile(f"The directory of {name} is damaged")
        entry, at = at, at + 46 + called + extra + comment
        size += packed + EACH
        if size < most and here + at < end:
            continue
        member = None
        if not most:
            raw = held[entry + 46 : entry + 46 + called]
            member = _zip_entries(held[entry:at])[0].filename if extra or b"\0" in raw else raw.decode("utf-8" if flags & 0x800 else "cp437")
        if member is None or not member.endswith("/"):
            yield Unit(name, name if member is None else f"{name}/{member}", "zip", size - EACH, start, here + at - start, shift)
            start = here + at
        size = 0


def dealt(units: Iterator[Unit], most: int) -> list[list[Unit]]:
    """Units in order, in groups of about `most` bytes; a unit is never split. Of members that follow each other, no more is kept than the part of the
    index that they stand in, so the groups of an archive are small however many members it has."""
    out: list[list[Unit]] = [[]]
    first = last = None  # of members that follow each other
    held = size = 0

    def close() -> None:
        if first is not None:
            out[-1].append(first if first is last else replace(first, name=first.path, size=size, length=last.at + last.length - first.at))

    for u in units:
        full = held and held + u.size > most
        if full or first is None or not last.goes_on_with(u):
            close()
            first, size = u, 0
        if full:
            out.append([])
            held = 0
        last = u
        size += u.size
        held += u.size + EACH
    close()
    return [x for x in out if x]


def contents(units: list[Unit]) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of each document."""
    for u in units:
        fs, path = opened(u.path)
        if u.kind == "stream":
            unpacked = (lambda raw: gzip.GzipFile(fileobj=raw)) if path.endswith(".gz") else bz2.BZ2File  # both read streams that follow each other as one
            with fs.open_input_stream(path, compression=None) as raw, unpacked(raw) as whole, tarfile.open(fileobj=whole, mode="r|") as archive:
                for m in archive:
                    archive.members = []
                    if m.isfile():
                        yield f"{u.name}/{m.name}", archive.extractfile(m).read()
            continue
        with fs.open_input_file(path) as file:
            file.seek(u.at)
            if u.kind == "zip":
                for m in _zip_entries(file.read(u.length)):
                    if not m.is_dir():
                        yield f"{u.path}/{m.filename}", _zip_member(file, u, m)
            elif u.kind == "tar":
                with tarfile.open(fileobj=file, mode="r:", pax_headers=dict(u.headers)) as archive:
                    for m in archive:
                        archive.members = []
                        if m.isfile():
                            yield f"{u.path}/{m.name}", archive.extractfile(m).read()
                        if archive.offset >= u.at + u.length:
                            break
            else:
                data = file.read(u.size)
                yield u.name, gzip.decompress(data) if path.endswith(".gz") else bz2.decompress(data) if path.endswith(".bz2") else data


def _zip_member(file: pa.NativeFile, unit: Unit, m: zipfile.ZipInfo) -> bytes:
    at = unit.shift + m.header_offset
    file.seek(at)
    file.seek(at + 30 + sum(struct.unpack("<HH", file.read(30)[26:30])))
    data = file.read(m.compress_size)
    if m.compress_type == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    if zlib.crc32(data) != m.CRC:
        raise ValueError(f"{unit.path}/{m.filename} is damaged")
    return data


def _condition(text: str) -> tuple[str, str, str]:
    """`SEC:KEY=value` as section, key and value."""
    key, sign, value = text.partition("=")
    code, colon, key = key.partition(":")
    if not sign or not colon:
        raise ValueError(f"{text!r} is no condition SEC:KEY=value")
    return SECTIONS.get(code, code), key, value


class Reader(DataSourceReader):
    def __init__(self, options: dict, table: str, schema: object):
        self.path, self.table, self.schema = options.get("path"), table, schema
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted = {c: options[c] for c in self.chosen_by() if c in options}
        self.where = _condition(options["where"]) if "where" in options else None
        if not self.path:
            raise ValueError("assaytab needs a path")

    def chosen_by(self) -> tuple[str, ...]:
        """Columns by whose value files are left unread, or lines unparsed."""
        return {"items": ("file_id", "section"), "cells": ("file_id", "tbl"), "values": ("file_id", "tbl")}.get(self.table, ("file_id",))

    def partitions(self) -> list[Units]:
        only = self.wanted.get("file_id")
        units = (u for u in units_of(self.path, 0 if only else self.most) if only is None or u.name == only or (u.kind == "stream" and only.startswith(f"{u.name}/")))
        return [Units(x) for x in dealt(units, self.most)]

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        size = 0
        for name, data in contents(partition.units):
            if self.wanted.get("file_id") not in (None, name):
                continue
            try:
                text, error = data.decode("utf-8"), None
            except UnicodeDecodeError as fault:
                text, error = None, str(fault)
            if self.where and not holds(text or "", *self.where):
                continue
            if self.table == "documents":
                new = iter([(text, error)])
            else:
                new = rows_of(text or "", self.table, self.wanted.get("section"), self.wanted.get("tbl"))
            try:
                for row in new:
                    rows.append((name, *row))
                    size += len(text or "") if self.table == "documents" else 0
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            except (ValueError, TypeError, KeyError, AttributeError):  # a document that can't be read has an error in `documents` and no rows elsewhere
                rows = [r for r in rows if r[0] != name]
        if rows:
            yield _batch(rows, schema)


class FilteredReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of file_id, and of what the table's rows are parsed by; all else is Spark's."""
        mine = self.chosen_by()
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in mine and f.attribute[0] not in self.wanted and isinstance(f.value, str):
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: files of their own (a folder), or a part of an archive and the entries of its directory."""

    path: str
    size: int = 0
    names: int = 0
    partition: int = 0


def _zip_head(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name), 0) + name


_ENTRY = struct.Struct("<3I2Q")  # length of the name, crc, place in the part; packed and whole size


def _zip_entry(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    far = offset >= 0xFFFFFFFF
    extra = struct.pack("<HHQ", 1, 8, offset) if far else b""
    return struct.pack("<4s6H3I5H2I", b"PK\1\2", 45 if far else 20, 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if far else offset) + name + extra


def _zip_end(n: int, size: int, offset: int) -> bytes:
    out = b""
    if n >= 0xFFFF or offset >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
        out = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + size, 1)
    return out + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


class Writer(DataSourceWriter):
    """Rows of (name, text): a file each below the path, or one archive of all of them at the path."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.archive, self.overwrite = options["path"], options.get("archive", ""), overwrite
        if self.archive and self.archive not in ARCHIVES:
            raise ValueError(f"Unknown archive {self.archive}")
        fs, path = opened(self.path)
        if self.archive and not overwrite and fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(self.path)
        head, _, tail = path.rstrip("/").rpartition("/")
        self.hidden = f"{head}/.{tail}-{uuid.uuid4().hex}"
        fs.create_dir(self.hidden, recursive=True)

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        fs, _ = opened(self.path)
        place, partition = f"{self.hidden}/{uuid.uuid4().hex}", TaskContext.get().partitionId()
        fs.create_dir(place, recursive=False)  # which fails once the job has been given up
        if self.archive:
            return self._part(fs, place, partition, rows)
        n = 0
        for name, text in rows:
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name below a folder")
            at = f"{place}/{name}"
            for i in (i for i, c in enumerate(name) if c == "/"):
                fs.create_dir(f"{place}/{name[:i]}", recursive=False)
            if fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
                raise ValueError(f"Several documents would be written to {name}")
            with fs.open_output_stream(at) as out:
                out.write((text or "").encode())
            n += 1
        return Part(place, 0, n, partition)

    def _part(self, fs: pyarrow.fs.FileSystem, place: str, partition: int, rows: Iterator) -> Part:
        size = n = 0
        with fs.open_output_stream(f"{place}/members") as out, fs.open_output_stream(f"{place}/entries") as entries:
            for name, text in rows:
                data, called = (text or "").encode(), name.encode()
                if self.archive == "zip":
                    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
                    packed, crc = pack.compress(data) + pack.flush(), zlib.crc32(data)
                    if max(len(packed), len(data)) >= 0xFFFFFFFF:
                        raise ValueError(f"{name} is too long for a zip archive")
                    entries.write(_ENTRY.pack(len(called), crc, 0, len(packed), len(data)) + struct.pack("<Q", size) + called)
                    member = _zip_head(called, crc, len(packed), len(data)) + packed
                else:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    member = info.tobuf(tarfile.PAX_FORMAT) + data + bytes(-len(data) % 512)
                    member = _PACK.get(self.archive, lambda x: x)(member)  # streams may follow each other
                out.write(member)
                size += len(member)
                n += 1
        return Part(place, size, n, partition)

    def commit(self, parts: list[Part | None]) -> None:
        fs, path = opened(self.path)
        parts = sorted((p for p in parts if p is not None), key=lambda p: p.partition)
        if self.archive:
            with fs.open_output_stream(f"{self.hidden}/whole") as out:
                self._string(fs, parts, out)
            fs.move(f"{self.hidden}/whole", path)
        else:
            files = [(p, f.path[len(p.path) + 1 :]) for p in parts for f in fs.get_file_info(pyarrow.fs.FileSelector(p.path, recursive=True)) if f.is_file]
            names = [name for _, name in files]
            if len(set(names)) < len(names):
                raise ValueError(f"Several documents would be written to {max(names, key=names.count)}")
            if self.overwrite and fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
                fs.delete_dir_contents(path)
            fs.create_dir(path, recursive=True)
            for p, name in files:
                fs.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
                fs.move(f"{p.path}/{name}", f"{path}/{name}")
        self.abort([])

    def _string(self, fs: pyarrow.fs.FileSystem, parts: list[Part], out: pa.NativeFile) -> None:
        for p in parts:
            with fs.open_input_stream(f"{p.path}/members") as part:
                while piece := part.read(PIECE):
                    out.write(piece)
        if self.archive != "zip":
            out.write(_PACK.get(self.archive, lambda x: x)(bytes(1024)))
            return
        offset = size = 0
        whole, n = sum(p.size for p in parts), sum(p.names for p in parts)
        for p in parts:
            with fs.open_input_stream(f"{p.path}/entries", buffer_size=PIECE) as entries:
                for _ in range(p.names):
                    length, crc, _, packed, real = _ENTRY.unpack(entries.read(_ENTRY.size))
                    (place,) = struct.unpack("<Q", entries.read(8))
                    entry = _zip_entry(entries.read(length), crc, packed, real, offset + place)
                    out.write(entry)
                    size += len(entry)
            offset += p.size
        out.write(_zip_end(n, size, whole))

    def abort(self, parts: list[Part | None]) -> None:
        """Takes away all that tasks have written and that was not moved into place."""
        fs, _ = opened(self.path)
        if fs.get_file_info(self.hidden).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self.hidden)


class AssayTab(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assaytab"

    def _table(self) -> str:
        table = self.options.get("table", "documents")
        if table != "documents" and table not in READ:
            raise ValueError(f"{table} is none of documents, {', '.join(READ)}")
        return table

    def schema(self) -> str:
        return f"file_id string, {READ.get(self._table(), DOCUMENTS)}"

    def reader(self, schema: object) -> Reader:
        kind = FilteredReader if self.options.get("filters", "false") == "true" else Reader
        return kind(self.options, self._table(), schema)

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)
