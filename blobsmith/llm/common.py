"""What the operators of this subpackage share: materialising, sizing, text batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold, and bytes after which it ends, so that batches of long texts stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: A key with a share of more than 1 / HOT of a table's rows is dealt to SPREAD tasks.
HOT, SPREAD = 1000, 64
#: Characters a worker handles at a time; a longer text makes a chunk of its own.
CHUNK_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine sees: spark.checkpoint.dir. Where that is unset a folder of our own will do on one machine (tests); on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every machine sees")
        found = tempfile.mkdtemp(prefix="blobsmith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage at a reliable place: a lost executor costs the tasks it ran, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ARROW_ROWS rows and ARROW_BYTES in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) lists of at most `limit` characters (or one row) from batches whose first columns are id and text."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and size + len(text or "") > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text or "")
        if ids:
            yield ids, texts


def hot_keys(large: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts): the keys with more than a share of 1 / HOT of large, of which there are HOT at most."""
    least = large.count() // HOT
    return large.groupBy(*keys).count().where(F.col("count") > max(least, SPREAD)).select(*keys, F.lit(SPREAD).alias("parts"))


def spread_join(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """large joined (inner or left) with small, in which a key has few rows, however many rows of large a key has.

    Rows of a hot key (hot_keys) are dealt to SPREAD tasks, by a hash of the other columns, and small's rows of it are sent to each.
    Nothing is dealt where no key is hot. large should be a written table, as it is read more than once.
    """
    keys = [on] if isinstance(on, str) else on
    if hot is None:
        hot = materialize(hot_keys(large, keys), "hot")
    if not hot.limit(1).count():
        return large.join(small, keys, how)
    hot, own = F.broadcast(hot), [c for c in large.columns if c not in keys]  # HOT rows at most
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*own), F.lit(SPREAD)))
    dealt = large.join(hot, keys, "left").withColumn("salt", salt.cast("int")).drop("parts")
    copies = small.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the smallest node.

    Each round takes the least label among the neighbours and then the label of that label, so the rounds grow with
    the logarithm of the longest path. Labels are written out each round. Null ends are ignored; an empty
    input gives no rows. Nodes without an edge are not listed.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = materialize(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        moved = lower.join(jump, "to", "left").select("node", "was", F.least("to", "next").alias("component"))
        moved = materialize(moved, "labels")
        changed = moved.where("component <> was").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
