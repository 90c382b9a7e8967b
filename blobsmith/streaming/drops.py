"""Archives dropped into a folder, read as they come (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsmith.schema import ENTRY
from blobsmith.sources.archive import Archive

_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_entries(spark: SparkSession, folder: str, files_per_batch: int = 100, content: bool = True) -> DataFrame:
    """A streaming DataFrame of the entries of new archives and when these came (arrived)."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary(), pa.timestamp("us", "UTC")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, arrived, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(*r, arrived) for r in Archive(data).entries(name, content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*ENTRY.names, "arrived"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.fields) + ", arrived timestamp"
    return files.select("path", "modificationTime", "content").mapInArrow(run, schema)


def arrivals(entries: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Entries and bytes in each window of arrival; rows later than the watermark are dropped by Spark."""
    return entries.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("n"), F.sum("data_size").alias("bytes"))
