"""Quality by importance resampling with hashed n-gram models.

Words and pairs of adjacent words are hashed into buckets. The bucket shares of target texts and of all (raw) texts are two
generative models; the log of their ratio, summed over a text, is its importance weight. Adding Gumbel noise to the log
weights and keeping the top k draws k texts without replacement in proportion to their weights.

The target model is fitted to at most about TARGETS documents, chosen by a hash of their ids, so that their ids can be broadcast and no text
is shuffled; the raw model counts every text. Both are counted in one pass, weights are given in a second one.

The noise comes from a hash of the id and a seed, so a draw can be repeated. The threshold for the top k is found by
counting keys into ever finer bins, in a few passes over a narrow table, not by sorting all rows in one place.

Defined results: a null text, or one without a word, weighs 1 (log weight 0); rows without an id take part, all with the
same noise, as do rows that repeat an id; where keys are equal at the threshold, rows written first are kept, so that exactly k are. Other
columns are ignored; an empty table draws nothing. A target without texts makes all weights 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import arrow_type
from .common import materialize, small_batches, text_chunks

BUCKETS = 10_000
SEED = 1
#: About how many target documents the target model is fitted to at most.
TARGETS = 50_000
#: Added to every bucket's count.
SMOOTHING = 1.0
_BINS = 4096


def hashed(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of adjacent words of a text, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    pairs = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA77 + 1) & 0x7FFFFFFFFFFFFFFF
    return np.concatenate([one, pairs ^ (pairs >> 29)]) % buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket is met in the texts of docs (text, target) that are targets, and in all.

    Tasks count on their own; `buckets` rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for known, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                each = np.bincount(hashed(text.as_py(), buckets), minlength=buckets)
                raw += each
                if known:
                    target += each
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, target[at], raw[at])], ["bucket", "target", "raw"])

    each = docs.select("text", "target").mapInArrow(run, "bucket long, target long, raw long")
    found = each.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in found:
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log of each bucket's smoothed share in the target over that in the raw texts."""
    if not target.sum():
        return np.zeros(len(raw))
    a, b = target + SMOOTHING, raw + SMOOTHING
    return np.log(a / a.sum()) - np.log(b / b.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, log_weight) of each row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches):
            each = [hashed(t, len(ratio)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array([len(x) for x in each], pa.int64()), pa.array([float(ratio[x].sum()) for x in each], pa.float64())],
                ["doc_id", "n_features", "log_weight"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features long, log_weight double")


def kth_largest(values: DataFrame, k: int) -> float | None:
    """The k-th largest of values (key), by counting into bins within ever narrower bounds; None if there are fewer."""
    low, high, n = values.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / _BINS
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1))
        inside = values.where((F.col("key") >= low) & (F.col("key") <= high)) if width > 0 else values.limit(0)
        found = {r["bin"]: r for r in inside.groupBy(at.alias("bin")).agg(
            F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        if not found:
            break
        for b in sorted(found, reverse=True):
            if found[b]["n"] >= k:
                break
            k -= found[b]["n"]
        if len(found) == 1 and (found[b]["low"], found[b]["high"]) == (low, high):
            break
        low, high = found[b]["low"], found[b]["high"]
    return high


def resample(weights: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """weights (doc_id, log_weight, row, ...) with gumbel_key and kept: the top k of log weight plus Gumbel noise.

    weights should be a written table: it is read in a few passes. row: numbers that differ, to settle equal keys; dropped.
    """
    share = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(share)))
    key, place = F.col("gumbel_key"), -F.col("row").cast("double")
    least = kth_largest(keyed.select(key.alias("key")), k)
    if least is None:
        return keyed.withColumn("kept", F.lit(k > 0)).drop("row")
    above = keyed.where(key > least).count()
    last = kth_largest(keyed.where(key == least).select(place.alias("key")), k - above)
    return keyed.withColumn("kept", (key > least) | ((key == least) & (place >= last))).drop("row")


def select(docs: DataFrame, good: DataFrame, share: float, seed: int = SEED, buckets: int = BUCKETS, targets: int = TARGETS) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, kept): `share` of the rows of docs drawn towards the good ones.

    docs: (doc_id, text). good: (doc_id) of the target documents, of which about `targets` are learned from at most.
    """
    small_batches(docs.sparkSession)
    docs, good = docs.select("doc_id", "text"), good.select("doc_id").where("doc_id is not null").distinct()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = good.where(chance < targets / max(1, good.count())).withColumn("target", F.lit(True))
    ratio = log_ratio(*bucket_counts(docs.join(F.broadcast(chosen), "doc_id", "left"), buckets))
    weights = materialize(weigh(docs, ratio).withColumn("row", F.monotonically_increasing_id()), "weights")
    return resample(weights, round(share * weights.count()), seed)
