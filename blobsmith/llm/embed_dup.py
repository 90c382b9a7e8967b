"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its PREFIX nearest reference points (pivots), in order. Inverted lists, one for each pivot, hold the vectors it is among
the nearest of. Two vectors that meet in a list are a candidate if they share at least SHARED pivots; a candidate is counted in the list of
the first pivot shared only, and is a link if its cosine, in double precision, is at least `cosine`. So no link is below it; pairs that
share too few pivots are missed.

Equal vectors form a class that is indexed once. The pivots are chosen from a sample of the classes by a hash, PIVOTS_PER_ROOT times the
root of their number, at most MOST_PIVOTS. They are kept apart: a point that is near one already chosen is skipped, so that a dense group does not
take the pivots and its members are told by far points, which they share. A list of more than BLOCK vectors is split, and its parts meet two by two, so no task holds a
long list; a task compares tiles of TILE, and reports how many links each vector has and the local components, not its pairs. Lists hold about
PREFIX / PIVOTS_PER_ROOT times the root of the number of vectors each, where no group is dense; the pairs within a dense group are all compared, as each may be a link that counts.

Defined results: vectors that are null or zero or hold null or non-finite components are linked with nothing, as are
vectors of different lengths with one another. A row without an id is counted in no class and linked with nothing. Rows
that repeat an id count as rows. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import arrow_type
from .common import components, materialize, small_batches, spread_join

COSINE = 0.95
PIVOTS_PER_ROOT = 4
LEAST_PIVOTS, MOST_PIVOTS = 64, 32_768
PREFIX, SHARED = 10, 2
#: Cosines below which two pivots must be, the first that leaves half as many as wanted.
APART = (0.8, 0.9, 0.95, 0.98, 2.0)
BLOCK = 4096
TILE = 1024
#: Of a tile, the share of candidates from which on all its cosines are worked out at once.
DENSE = 0.05
#: Rows described at a time.
_ROWS = 1024


def unit_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, key, raw): key a digest of the vector in double precision, raw the vector as it is; both null where it has no direction."""
    small_batches(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for vector in batch.column(1).to_pylist():
                x = np.array([np.nan if v is None else v for v in vector or ()], np.float64)
                good = bool(len(x)) and np.isfinite(x).all() and x.any()
                keys.append(hashlib.md5((x + 0.0).tobytes()).hexdigest() if good else None)
                raws.append(vector if good else None)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0), kind), pa.array(keys, pa.string()), pa.array(raws, values)], ["vec_id", "key", "raw"])

    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    kind, values = arrow_type(rows, "vec_id"), arrow_type(rows, "embedding")
    types = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "embedding")]
    return rows.mapInArrow(run, f"vec_id {types[0]}, key string, raw {types[1]}")


def units(raws: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = np.stack(raws.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kept_apart(points: np.ndarray, wanted: int) -> np.ndarray:
    """`wanted` of the points at most, taken in order, of which no two are near each other, as far as enough remain."""
    for apart in APART:
        kept = points[:0]
        for a in range(0, len(points), 256):
            part = points[a : a + 256]
            part = part[(part @ kept.T).max(1, initial=-1) < apart]
            near, alive = part @ part.T >= apart, np.ones(len(part), bool)
            np.fill_diagonal(near, False)
            for i in range(len(part)):
                if alive[i]:
                    alive[i + 1 :] &= ~near[i, i + 1 :]
            kept = np.concatenate([kept, part[alive]])
            if len(kept) >= wanted:
                break
        if 2 * len(kept) >= min(wanted, len(points)):
            break
    return kept[:wanted]


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The numbers of the nearest pivots of each unit vector, nearest first (vectors x prefix)."""
    wide = min(prefix, len(pivots))
    out = []
    for a in range(0, len(vectors), _ROWS):
        near = vectors[a : a + _ROWS] @ pivots.T
        at = np.argpartition(-near, wide - 1, axis=1)[:, :wide] if wide < len(pivots) else np.tile(np.arange(wide), (len(near), 1))
        out.append(np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, wide), np.int64)


def shared_counts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many pivots each two permutations share (left x right), by bitmaps over the pivots that both sides hold."""
    known = np.intersect1d(left, right)
    maps = []
    for side in (left, right):
        at = np.searchsorted(known, side)
        at = np.where(known[np.minimum(at, len(known) - 1)] == side, at, len(known)) if len(known) else np.zeros_like(side)
        bits = np.zeros((len(side), len(known) // 64 + 1), np.uint64)
        rows, columns = np.nonzero(at < len(known))
        found = at[rows, columns]
        np.bitwise_or.at(bits, (rows, found // 64), np.uint64(1) << (found % 64).astype(np.uint64))
        maps.append(bits)
    out = np.zeros((len(left), len(right)), np.uint8)
    for word in range(maps[0].shape[1]):
        out += np.bitwise_count(maps[0][:, word, None] & maps[1][None, :, word])
    return out


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, pivot: int, cosine: float, shared: int = SHARED) -> np.ndarray:
    """Which pairs of two tiles of the list of a pivot are links to be counted there: candidates whose first shared pivot, by number, it is."""
    candidates = shared_counts(of_a, of_b) >= min(shared, of_a.shape[1])
    i, j = np.nonzero(candidates)
    if len(i) > DENSE * candidates.size:
        good = (a @ b.T)[i, j] >= cosine
    else:
        good = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
    i, j = i[good], j[good]
    out = np.zeros(candidates.shape, bool)
    for k in range(0, len(i), 1 << 16):
        at = slice(k, k + (1 << 16))
        same = of_a[i[at]][:, :, None] == of_b[j[at]][:, None, :]
        first = np.where(same.any(2), of_a[i[at]], np.iinfo(of_a.dtype).max).min(1)
        out[i[at], j[at]] = first == pivot
    return out


def compare(left: pd.DataFrame, right: pd.DataFrame | None, pivot: int, cosine: float) -> pd.DataFrame:
    """(no, links, other) of all pairs within a part of a pivot's list, or of two parts, tile by tile."""
    def tiles(frame: pd.DataFrame) -> list[tuple]:
        parts = (frame.iloc[k : k + TILE] for k in range(0, len(frame), TILE))
        return [(units(p["raw"]), np.stack(p["near"].to_numpy()), p["no"].to_numpy(), p["size"].to_numpy()) for p in parts]

    rows = tiles(left)
    columns, found = rows if right is None else tiles(right), []
    for i, (a, of_a, no_a, size_a) in enumerate(rows):
        for j, (b, of_b, no_b, size_b) in enumerate(columns):
            if right is None and j < i:
                continue
            pairs, same = linked(a, b, of_a, of_b, pivot, cosine), right is None and i == j
            if same:
                np.fill_diagonal(pairs, False)
            found.append(reduced(pairs, no_a, no_b, size_a, size_b, same))
    none = pd.DataFrame({"no": [], "links": [], "other": []}, dtype=np.int64)
    return pd.concat(found).groupby(["no", "other"], as_index=False)["links"].sum()[["no", "links", "other"]] if found else none


def reduced(pairs: np.ndarray, left: np.ndarray, right: np.ndarray, size_left: np.ndarray, size_right: np.ndarray, same: bool) -> pd.DataFrame:
    """(no, links, other): how many vectors each class is linked with here, and an edge towards its local component."""
    n = len(left)
    names = left if same else np.concatenate([left, right])
    i, j = np.nonzero(pairs)
    links = np.bincount(i, size_right[j], len(names))
    if not same:
        links += np.bincount(j + n, size_left[i], len(names))
        j = j + n
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = pd.DataFrame({"no": names, "links": links.astype(np.int64), "other": names[label]})
    return out[out["links"] > 0]


def link(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = materialize(unit_vectors(table, id_col, vector_col), "units")
    whole = rows.where("key is not null and vec_id is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("raw").alias("raw"))
    # a number stands for a class from here on
    classes = materialize(whole.withColumn("no", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOTS_PER_ROOT * n**0.5)))
    # about twice as many as are wanted, by a hash, so that no sort takes all classes
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / (1 << 30)
    sample = classes.where(chance < min(1.0, 2 * wanted / max(1, n))).select("key", "raw").toPandas().sort_values("key")
    pivots = {length: kept_apart(units(part["raw"]), wanted) for length, part in sample.groupby(sample["raw"].map(len))}

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, part in frame.groupby(frame["raw"].map(len)):
                # no pivot has this length: one list for all
                near = permutations(units(part["raw"]), pivots[length]) if length in pivots else np.zeros((len(part), 1), np.int64)
                yield part.assign(length=length, near=list(near.astype(np.int32)))

    kind = classes.schema["raw"].dataType.simpleString()
    index = materialize(classes.select("no", "size", "raw").mapInPandas(described, f"no long, size long, raw {kind}, length long, near array<int>"), "index")
    entries = index.select("*", F.explode("near").alias("pivot"))
    # a row for each pivot, and for each length without one
    parts = entries.groupBy("length", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    entries = entries.join(F.broadcast(parts), ["length", "pivot"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("no"), F.col("parts")).cast("int")
    entries = entries.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "length", "pivot", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "no", "size", "raw", "near")

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        low, high, pivot = (int(group[c].iat[0]) for c in ("low", "high", "pivot"))
        return compare(group[group["own"] == low], None if low == high else group[group["own"] == high], pivot, cosine)

    found = materialize(entries.groupBy("length", "pivot", "low", "high").applyInPandas(lists, "no long, links long, other long"), "found")
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("no").alias("a"), F.col("other").alias("b")))
    facts = classes.select("no", "key", "rep", "size").join(links, "no", "left").join(joined.withColumnRenamed("node", "no"), "no", "left")
    facts = materialize(facts.withColumn("component", F.coalesce("component", "no")), "facts")
    least = facts.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = spread_join(facts, least, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    component = F.coalesce("component_id", "vec_id")
    own_key = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    known = spread_join(own_key.where("key is not null"), facts, "key").unionByName(own_key.where("key is null"), allowMissingColumns=True)
    return known.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
