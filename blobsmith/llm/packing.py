"""Packing documents into sequences by fitted length patterns.

Documents become token ids and a separator, cut into pieces of at most `capacity`. The histogram of piece lengths has at
most `capacity` rows, so it is planned on the driver whatever the size of the corpus:

1. lengths are put into bins; every multiset of up to PARTS bins that fills a sequence is a pattern;
2. non-negative least squares finds how often to repeat each pattern to use up the histogram;
3. the counts are rounded down, and each repeat is made of exact lengths, the last slot taking the best fit;
4. what is left is packed longest first, each sequence filled with the longest that still fits.

The plan says for the k-th piece of a length which sequence and offset it gets. Spark numbers the pieces of each length,
spreading a frequent length over many salted groups, and looks the plan up.

Defined results: a null text is empty and takes one token, the separator; null and repeated ids are packed row by row;
other columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, small_batches, text_chunks

CAPACITY = 2048
SEPARATOR = 0
BINS = 128
PARTS = 4


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the pieces of each document; ids binary, little-endian 32-bit."""
    small_batches(docs.sparkSession)
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches):
            rows = [
                (key, i, i * capacity, len(part) // 4, part)
                for key, ids in zip(keys, bpe.encoder(path).encode(texts), strict=True)
                for i, part in enumerate(_parts(ids + end, 4 * capacity))
            ]
            columns = zip(*rows, strict=True)
            kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = bpe.arrow_type(docs, "doc_id")
    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {name}, piece int, start long, length long, ids binary")


def _parts(ids: bytes, size: int) -> list[bytes]:
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method, a column entering at a time."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-8 * max(1.0, np.abs(b).max(initial=0))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        if free.sum() == a.shape[0] or gain.max(initial=-np.inf) <= least:
            break
        free[gain.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            free[at[(x[at] <= 1e-12) & low]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(bins: int = BINS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Every multiset of at most `parts` bins, largest first, that fills a sequence."""
    out = []

    def grow(prefix: tuple[int, ...], rest: int) -> None:
        if not rest:
            out.append(prefix)
        elif len(prefix) < parts:
            for b in range(min(rest, prefix[-1] if prefix else bins), 0, -1):
                if b * (parts - len(prefix)) < rest:
                    break
                grow((*prefix, b), rest - b)

    grow((), bins)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, parts: int = PARTS) -> pd.DataFrame:
    """Slots (length, first, count, times, sequence, offset).

    The pieces number first .. first + count - 1 of a length go into the sequences from `sequence` on, `times` of them
    side by side in each from `offset` on. The rows are bounded by the capacity: each batch of equal sequences uses up
    the pieces of some length, and holds fewer than sqrt(2 * capacity) different lengths.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used, slots, made = np.zeros(capacity + 1, np.int64), [], 0

    def emit(lengths: list[int], most: int | None = None) -> int:
        """As many sequences of these lengths as there are pieces for, up to `most`."""
        nonlocal made
        kinds, times = np.unique(lengths, return_counts=True)
        n = int((left[kinds] // times).min())
        n = n if most is None else min(n, most)
        offset = 0
        for length, k in sorted(zip(kinds.tolist(), times.tolist(), strict=True), reverse=True):
            if n:
                slots.append((length, int(used[length]), n * k, k, made, offset))
            used[length] += n * k
            left[length] -= n * k
            offset += k * length
        made += n
        return n

    def longest(below: int, taken: list[int], above: int = 1) -> int:
        """The longest length in above..below of which a piece is left beside those taken; 0 if none."""
        while below >= above:
            found = np.flatnonzero(left[above : below + 1])
            if not len(found):
                return 0
            below = above + int(found[-1])
            if left[below] > taken.count(below):
                return below
            below -= 1
        return 0

    if left[capacity]:
        emit([capacity])
    width = capacity / bins
    lengths = np.flatnonzero(left)
    if len(lengths) and width >= 1:
        of = np.minimum((lengths + width / 2) // width, bins).astype(int)
        want = np.bincount(of, left[lengths], bins + 1)[1:]
        known = [p for p in patterns(bins, parts) if all(want[b - 1] for b in p)]
        a = np.zeros((bins, len(known)))
        for i, p in enumerate(known):
            np.add.at(a[:, i], np.array(p) - 1, 1)
        repeats = np.floor(nnls(a, want) + 1e-6).astype(int) if known else np.zeros(0, int)
        for i in np.argsort(-repeats, kind="stable"):
            n = int(repeats[i])
            while n > 0:
                taken: list[int] = []
                for k, b in enumerate(known[i]):
                    rest, low, high = capacity - sum(taken), int((b - 0.5) * width), int((b + 0.5) * width)
                    last = k == len(known[i]) - 1
                    taken.append(longest(rest if last else min(rest, high), taken, max(1, int(rest - width) if last else low)))
                if not all(taken):
                    break
                n -= emit(taken, n)
    while left.any():
        taken = []
        while (length := longest(capacity - sum(taken), taken)):
            taken.append(length)
        emit(taken)
    return pd.DataFrame(slots, columns=["length", "first", "count", "times", "sequence", "offset"]).sort_values(["length", "first"])


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset added. `pieces` should be a written table: it is read twice."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, capacity)
    salts = max(64, isqrt(sum(histogram.values())))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_salt").orderBy(*[F.col(c) for c in pieces.columns if c != "length"])
    numbered = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_salt"])
    numbered = numbered.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")
    start, first, times, sequence, offset = (
        slots[c].to_numpy(np.int64) for c in ("length", "first", "times", "sequence", "offset"))
    scale = max(histogram.values(), default=0) + 1
    keys = start * scale + first

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, length * scale + rank, side="right") - 1
            k = rank - first[at]
            yield frame.drop(columns="_rank").assign(
                sequence_id=sequence[at] + k // times[at], offset=offset[at] + k % times[at] * length)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInPandas(look_up, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of docs with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut(docs, path, capacity, id_col, text_col)
    narrow = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(materialize(narrow, "pieces"), capacity)


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from place() and cut(), ids of documents unique."""
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids")).select("sequence_id", (F.length("ids") / 4).cast("long").alias("length"), "ids")
