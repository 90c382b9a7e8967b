"""Archives as tables, and tables as archives.

Reading goes through Spark's binaryFile source, so any store that Spark reaches will do: an archive is one row of bytes,
and its entry table is sliced inside the task. The format itself limits an archive to 2 GB. Without content the bytes of
entries are checked but not passed on.
"""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsmith.codecs.bytes import FormatError, crc32_msb, crc32_quarter, from_1252, to_1252
from blobsmith.functions.blobs import BATCH_BYTES, BATCH_ROWS, small_batches
from blobsmith.schema import ENTRY, HEADER, MARK_OF_3, VERSIONS, games

HEADER_SIZE = 20
NAME_SIZE = 16
#: The signature this writer leaves in the footer.
SIGNATURE = b"BSMT"


class Layout(NamedTuple):
    """What a version and record length bring with them."""

    version: int
    record: int
    entry_crc: str
    table_crc: bool
    footer: bool

    def checksum(self, data: bytes) -> int | None:
        if self.entry_crc == "none" or not data:
            return None
        return crc32_quarter(data) if self.entry_crc == "crc4" else crc32_msb(data)


LAYOUTS = {(v, r): Layout(v, r, *rest) for v, r, *rest in VERSIONS}


def layout_of(version: bytes, record: int) -> Layout:
    """The layout by the last of the version bytes; the swapped mark is version 3."""
    number = 3 if version == MARK_OF_3 else version[3] - 48
    found = LAYOUTS.get((number, record))
    if found is None:
        raise FormatError(f"no archive layout for version bytes {version.hex()} and records of {record}")
    return found


class Archive:
    """The parts of an archive's bytes."""

    def __init__(self, data: bytes):
        if len(data) < HEADER_SIZE:
            raise FormatError("shorter than a header")
        self.data = data
        self.read_length, self.version_bytes, self.count, self.record, self.offset = struct.unpack_from("<I4sIII", data)
        self.layout = layout_of(self.version_bytes, self.record)
        self.table = data[self.offset : self.offset + self.count * self.record]
        if len(self.table) < self.count * self.record:
            raise FormatError("the entry table is past the end")
        at = self.offset + len(self.table)
        self.table_crc = None
        if self.layout.table_crc and len(data) >= at + 4:
            self.table_crc = struct.unpack_from("<I", data, at)[0]
            at += 4
        rest = data[at:]
        n = 4 if self.layout.footer else 0
        self.footer = [rest[:n] or None, rest[n : 2 * n] or None, rest[2 * n : 3 * n] or None, rest[3 * n :] or None]

    def entries(self, name: str, content: bool) -> Iterator[tuple]:
        """Rows of ENTRY."""
        for i in range(self.count):
            first, offset, size, stamp = struct.unpack_from("<IIII", self.table, i * self.record)
            label = self.table[i * self.record + 16 : i * self.record + 16 + NAME_SIZE - 1].split(b"\0")[0]
            if size and offset + size > len(self.data):
                raise FormatError(f"entry {i} is past the end")
            blob = self.data[offset : offset + size] if size else b""
            crc = None
            if self.record == 36:
                crc = struct.unpack_from("<I", self.table, i * self.record + 32)[0]
            elif self.layout.version == 2:
                crc = first
            flags = first if self.layout.version >= 3 else None
            yield (name, i, from_1252(label), flags, offset, size, stamp, crc if size else None, self.layout.checksum(blob), blob if content else None)

    def header(self, name: str) -> tuple:
        """A row of HEADER."""
        own = crc32_msb(self.table) if self.layout.table_crc else None
        return (name, self.read_length, self.layout.version, self.version_bytes, self.count, self.record, self.offset, self.table_crc, own, *self.footer)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_entries(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """A row for each entry of the archives at path (a file, folder or pattern)."""
    return entries_of(_files(spark, path), content)


def entries_of(archives: DataFrame, content: bool = True) -> DataFrame:
    """A row for each entry of archives given as (name, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):  # one archive at a time, and its entries in small batches
                for rows in _parts(Archive(data.as_py()).entries(name.as_py(), content)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ENTRY.names)

    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
    small_batches(archives.sparkSession)
    return archives.mapInArrow(run, ENTRY)


def _parts(entries: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of ENTRY in lists that end as Arrow batches do."""
    rows, size = [], 0
    for row in entries:
        rows.append(row)
        size += len(row[-1] or b"")
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each archive at path: header, table checksum and footer."""
    return headers_of(_files(spark, path))


def headers_of(archives: DataFrame) -> DataFrame:
    """The same of archives given as (name, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Archive(d.as_py()).header(n.as_py()) for n, d in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], HEADER.names)

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 5, *[pa.binary()] * 4]
    small_batches(archives.sparkSession)
    return archives.mapInArrow(run, HEADER)


def build(entries: Iterable[dict], version: int = 3, record: int = 36, version_bytes: bytes | None = None, ip: bytes = b"\0\0\0\0") -> bytes:
    """The bytes of an archive: contents from byte 20 in order, the entry table, its checksum, the footer; header first."""
    layout = LAYOUTS.get((version, record))
    if layout is None:
        raise FormatError(f"no archive layout for version {version} and records of {record}")
    body, table, at, count = bytearray(), bytearray(), HEADER_SIZE, 0
    for count, e in enumerate(entries, 1):  # noqa: B007
        blob, name = bytes(e.get("content") or b""), to_1252(e["name"])
        if len(name) >= NAME_SIZE:
            raise FormatError(f"name too long: {e['name']}")
        crc = layout.checksum(blob) or 0
        first = crc if layout.version == 2 else int(e.get("dead_space_flags") or 0) if layout.version >= 3 else 0
        table += struct.pack("<IIII16s", first, at, len(blob), int(e.get("timestamp_s") or 0), name)
        table += struct.pack("<I", crc) if record == 36 else b""
        body += blob
        at += len(blob)
    if at + len(table) >= 1 << 31:
        raise FormatError("an archive holds less than 2 GB")
    end = struct.pack("<I", crc32_msb(bytes(table))) if layout.table_crc else b""
    end += ip + b"\0\0\0\0" + SIGNATURE if layout.footer else b""
    head = struct.pack("<I4sIII", HEADER_SIZE, version_bytes or b"PFF%d" % version, count, record, at)
    return b"".join((head, body, table, end))


def pack_archives(entries: DataFrame, version: int = 3, record: int = 36, keep_dead: bool = True) -> DataFrame:
    """(archive, content): the bytes of each archive from rows of ENTRY, in the order of their ids.

    An archive, at most 2 GB by its format, is put together in one task; archives are spread over tasks.
    """
    rows = entries if keep_dead else entries.where(
        "not (coalesce(dead_space_flags, 0) % 2 = 1 or upper(trim(name)) = '<DEAD SPACE>' or coalesce(octet_length(content), 0) = 0)")

    def one(group: pa.Table) -> pa.Table:
        # the entries stay in Arrow's columns; a few at a time become rows
        order = pc.sort_indices(group, [("id", "ascending")])
        own = group.select([c for c in ("name", "dead_space_flags", "timestamp_s", "content") if c in group.column_names]).combine_chunks()
        parts = (own.take(order.slice(i, BATCH_ROWS)) for i in range(0, len(order), BATCH_ROWS))
        made = build((e for part in parts for e in part.to_pylist()), version, record)
        return pa.table([pa.array([group["archive"][0].as_py()], pa.string()), pa.array([made], pa.binary())], ["archive", "content"])

    return rows.groupBy("archive").applyInArrow(one, "archive string, content binary")


def new_archives(wanted: DataFrame) -> DataFrame:
    """(archive, content): archives without entries, in the layout of each row's game (archive, game); an unknown game is an error."""
    from blobsmith.operators.relations import registered

    layouts = games(wanted.sparkSession)
    rows = registered(wanted.select("archive", "game"), "game", layouts, "game", ["version", "record_length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build([], v, r) for v, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["archive", "content"])

    return rows.select("archive", "version", "record_length").mapInArrow(run, "archive string, content binary")


def written(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content, timestamp_s) rows as files of a folder that all machines share; (name, path, size, error) of each.

    A file is written under another name and then renamed, so a target is never half written and a task may run twice. A time that cannot be set is
    no error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for name, data, stamp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = os.path.join(folder, os.path.basename(name))
                spare = f"{target}.{uuid.uuid4().hex}.tmp"
                try:
                    with open(spare, "wb") as f:
                        f.write(data)
                    if stamp is not None:
                        with contextlib.suppress(OSError, OverflowError):
                            os.utime(spare, (stamp, stamp))
                    os.replace(spare, target)
                    done.append((name, target, len(data), None))
                except OSError as e:
                    done.append((name, target, None, str(e)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], ["name", "path", "size", "error"])

    return files.select("name", "content", "timestamp_s").mapInArrow(run, "name string, path string, size long, error string")


def write_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes (archive, content) rows as files of the folder and returns (archive, path, size); one that cannot be written is an error."""
    done = written(archives.select(F.col("archive").alias("name"), "content", F.lit(None).cast("long").alias("timestamp_s")), folder)
    size = F.when(F.col("error").isNull(), F.col("size")).otherwise(F.raise_error("error").cast("long"))
    return done.select(F.col("name").alias("archive"), "path", size.alias("size"))


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Writes (name, text) rows as files in the archives' code page."""
    from blobsmith.functions.blobs import encode_1252

    return written(texts.select("name", encode_1252("text").alias("content"), F.lit(None).cast("long").alias("timestamp_s")), folder)


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder, without reading them."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"))


def export_plan(entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, content, timestamp_s) of the live entries that are not empty and can be written; names of `existing` are skipped."""
    from blobsmith.functions.text import sanitize_name
    from blobsmith.operators.listing import is_dead
    from blobsmith.operators.relations import without_conflicts

    live = ~is_dead(F.coalesce("dead_space_flags", F.lit(0)), F.col("name")) & (F.octet_length("content") > 0)
    rows = entries.where(live).select(sanitize_name(F.col("name")).alias("name"), "content", "timestamp_s")
    return rows if existing is None else without_conflicts(rows, existing, "name")


def export_entries(entries: DataFrame, folder: str, existing: DataFrame | None = None, overwrite: bool = True) -> DataFrame:
    """Writes what export_plan gives as files and returns (name, path, error).

    Names of `existing` are skipped, and without overwrite those the folder holds already.
    """
    if existing is None and not overwrite:
        existing = file_names(entries.sparkSession, folder)
    return written(export_plan(entries, existing), folder).drop("size")


def export_tally(entries: DataFrame, done: DataFrame) -> DataFrame:
    """One row: how many entries were chosen, can be exported, were, and failed. done: the written result of export_entries."""
    return done.agg(F.count_if(F.col("error").isNull()).alias("n_exported"), F.count_if(F.col("error").isNotNull()).alias("n_failed")).crossJoin(
        F.broadcast(entries.agg(F.count("*").alias("n_chosen")))).select("n_chosen", "n_exported", "n_failed")  # one row each
