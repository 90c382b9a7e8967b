"""spark.read.format("pff") and df.write.format("pff"), for folders that every machine mounts.

read: options content (true), header (false). write: options version (3), record (36), keep_dead (true); one archive, of less than 2 GB by its format, made
of all rows in the order of their ids; an archive that is there is replaced in mode overwrite only. Many archives are written by archive.pack_archives and
archive.write_archives, a task for each. Register with `spark.dataSource.register(PffSource)`.
"""

from __future__ import annotations

import glob
import os
import pickle
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from blobsmith.codecs.bytes import FormatError
from blobsmith.operators.changes import MOST_BYTES
from blobsmith.schema import ENTRY, HEADER
from blobsmith.sources.archive import Archive, build


@dataclass
class OneFile(InputPartition):
    path: str


class PffSource(DataSource):
    """The archive format by name."""

    @classmethod
    def name(cls) -> str:
        return "pff"

    def schema(self) -> StructType:
        return HEADER if self.options.get("header", "false").lower() == "true" else ENTRY

    def reader(self, schema: StructType) -> DataSourceReader:
        return PffReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PffWriter(self.options, schema.names, overwrite)


class PffReader(DataSourceReader):
    """A partition for each archive."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.content = options.get("content", "true").lower() == "true"
        self.header = options.get("header", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [OneFile(f) for f in found]

    def read(self, partition: OneFile):  # noqa: ANN201
        with open(partition.path, "rb") as f:
            archive = Archive(f.read())
        if self.header:
            yield archive.header(partition.path)
        else:
            yield from archive.entries(partition.path, self.content)


@dataclass
class Part(WriterCommitMessage):
    path: str
    size: int


class PffWriter(DataSourceWriter):
    """Tasks leave their rows beside the target; the commit, which alone knows all sizes, writes the archive and renames it."""

    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.version, self.record = int(options.get("version", 3)), int(options.get("record", 36))
        self.keep_dead = options.get("keep_dead", "true").lower() == "true"
        self.names, self.overwrite = names, overwrite

    def write(self, iterator):  # noqa: ANN001, ANN201
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"{self.path}.part-{context.partitionId()}-{context.taskAttemptId()}"
        size = 0
        with open(part, "wb") as f:
            for row in iterator:
                entry = dict(zip(self.names, row, strict=True))
                size += len(entry.get("content") or b"") + self.record
                if size > MOST_BYTES:
                    raise FormatError("an archive holds less than 2 GB")
                pickle.dump(entry, f)
        return Part(part, size)

    def commit(self, messages: list[Part]) -> None:
        if sum(m.size for m in messages) > MOST_BYTES:
            self.abort(messages)
            raise FormatError("an archive holds less than 2 GB")
        if not self.overwrite and os.path.exists(self.path):
            self.abort(messages)
            raise FileExistsError(f"{self.path} is there; write with mode overwrite")
        rows = []
        for m in messages:
            with open(m.path, "rb") as f:
                while True:
                    try:
                        rows.append(pickle.load(f))  # noqa: S301  written by the tasks above
                    except EOFError:
                        break
        rows.sort(key=lambda r: r["id"])
        if not self.keep_dead:
            rows = [r for r in rows if not (int(r.get("dead_space_flags") or 0) & 1 or r["name"].strip().upper() == "<DEAD SPACE>" or not r.get("content"))]
        data = build(rows, self.version, self.record)
        with open(f"{self.path}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{self.path}.tmp", self.path)
        self.abort(messages)

    def abort(self, messages: list[Part]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PffSource)
