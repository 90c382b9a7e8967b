"""MinHash near-duplicates with odd sketches.

A document is the set of its five-word shingles. Documents with the same set form a class, of which one stands for all.
MinHash samples of a class give band keys, and are folded into an odd sketch: a bitmap in which each sample flips one bit.
The bits in which two sketches differ estimate how many samples differ, precisely where similarity is high, so that pairs
of a band are first compared by sketches inside the join and only the rest on their full sets.

No band lists all its pairs. Each class is first checked against the most similar of a few hubs of its bands, and
components are formed; then, only where a band holds several components, its pairs across components are compared, and
checked where their sketches agree. A pair of one component needs no check, as it cannot change the components. A band with many
members is cut into parts of about PART, which meet two by two, so no task compares a large band. Where parts meet, pairs are
compared in place and are no rows: out come the members that have a pair to check, and then the links that join components there.

The similarity asked for decides the rows of a band: the most, up to ROWS, with which a pair of that similarity shares no band
with a probability of MISSED at most (with BANDS = 40: 7 rows and 2e-7 at 0.85, 5 rows and 1.2e-7 at 0.8), less above.

Defined results: a text that is null or has no word has an empty set and is linked with nothing; with fewer than five
words its whole sequence is one shingle. A row without an id is linked with nothing and kept. Rows that repeat an id are
classed by their own texts. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import arrow_type
from .common import components, materialize, small_batches, text_chunks

WORDS = 5
SIMILARITY = 85  # of a hundred, unless another is asked for
ROWS, BANDS = 7, 40
MISSED = 1e-6
SAMPLES = 1024
SKETCH_BITS = 2048
#: Pairs whose sketches say that they are so many standard deviations below the similarity are not checked.
DEVIATIONS = 4.5
#: Members of a band that others are compared with first, and how often each picks the most similar one.
HUBS, ROUNDS = 4, 2
#: Members of a band that are compared with each other in one place.
PART = 512

_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(max(WORDS, ROWS) + 1)], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of hashed shingles of a text, sorted."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    wide = min(words, n)
    out = np.full(n - wide + 1, wide, np.uint64)
    for i in range(wide):
        out += one[i : n - wide + 1 + i] * _MIX[i]
    return np.unique(scramble(out))


def samples(sets: list[np.ndarray], n: int = SAMPLES) -> np.ndarray:
    """MinHash samples (documents x n) of non-empty sets: two halves of each hash step through n hash functions."""
    out = np.empty((len(sets), n), np.uint32)
    if not sets:
        return out
    each = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    value, step = (each >> np.uint64(32)).astype(np.uint32), each.astype(np.uint32) | np.uint32(1)
    for i in range(n):
        value += step
        out[:, i] = np.minimum.reduceat(value, starts)
    return out


def band_rows(similarity: int = SIMILARITY) -> int:
    """The rows of a band for a similarity (of a hundred)."""
    fitting = (n for n in range(ROWS, 1, -1) if (1 - (similarity / 100) ** n) ** BANDS <= MISSED)
    return next(fitting, 1)


def band_keys(mins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band (documents x BANDS) of the first samples; keys of different bands differ too."""
    parts = mins[:, : rows * BANDS].reshape(len(mins), BANDS, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _MIX[ROWS], parts.shape[:2]).copy()
    for i in range(rows):
        keys = scramble(keys + parts[:, :, i] * _MIX[i])
    return keys.view(np.int64)


def odd_sketches(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The parity bitmap of each row's samples (documents x bits / 64, as signed integers)."""
    n, k = mins.shape
    at = scramble(mins.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + at.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def sketch_estimate(differ: float, n: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """The similarity that so many differing bits stand for."""
    return 1 + bits / (4 * n) * float(np.log(max(1e-9, 1 - 2 * differ / bits)))


def sketch_cut(similarity: int = SIMILARITY, n: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """DEVIATIONS standard deviations of the estimate, those of the samples and of the bits, below a similarity (of a hundred)."""
    s = similarity / 100
    kept = np.exp(-4 * n / bits * (1 - s))
    of_samples, of_bits = (s * (1 - s) / n) ** 0.5, (bits / 4 * (1 - kept**2)) ** 0.5 / (2 * n * kept)
    return float(s - DEVIATIONS * np.hypot(of_samples, of_bits))


def _most_differing(similarity: int, n: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    return int(bits / 2 * (1 - np.exp(-4 * n / bits * (1 - sketch_cut(similarity)))))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, fp, text_key, sketch, bands) of each row; fp is the digest of the set, null for an empty one."""
    small_batches(docs.sparkSession)
    n_rows = band_rows(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches, 1_000_000):
            sets = [shingles(t) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            mins = samples([sets[i] for i in full])
            sketch, bands = [None] * len(sets), [None] * len(sets)
            for i, s, b in zip(full, odd_sketches(mins).tolist(), band_keys(mins, n_rows).tolist(), strict=True):
                sketch[i], bands[i] = s, b
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, kind), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([hashlib.md5((t or "").encode()).hexdigest() for t in texts], pa.string()),
                pa.array(sketch, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "fp", "text_key", "sketch", "bands"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = arrow_type(docs, "doc_id")
    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {name}, n_shingles long, fp binary, text_key string, sketch array<long>, bands array<long>")


def _alike(a: str, b: str, similarity: int) -> Column:
    """The sketches and sizes of two classes allow the similarity."""
    return (_differ(a, b) <= _most_differing(similarity)) & (
        F.least(f"{a}.n_shingles", f"{b}.n_shingles") * 100 >= F.greatest(f"{a}.n_shingles", f"{b}.n_shingles") * similarity)


def _differ(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(SKETCH_BITS // 64)))


#: Where the parts of a band meet: the band's key and the two parts.
PLACE = ["key", "low", "high"]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each place, from batches that are sorted by PLACE."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        at = np.stack([table.column(c).to_numpy() for c in PLACE])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def _open_pairs(rows: pa.Table, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j after it) of the pairs of a place that have to be checked: of two components, alike, and not met in an earlier band."""
    component = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    if (component == component[0]).all():
        return
    own, size = rows.column("own").to_numpy(), rows.column("n_shingles").to_numpy()
    sketch, bands = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(own), -1) for c in ("sketch", "bands"))
    sketch = sketch.view(np.uint64)  # of a signed number, the bits of its absolute value are counted
    key, low, high = (rows.column(c)[0].as_py() for c in PLACE)
    most = _most_differing(similarity)
    for i in range(len(own) - 1):
        open_ = component[i + 1 :] != component[i]
        if low != high:
            open_ &= own[i + 1 :] != own[i]
        after = i + 1 + np.flatnonzero(open_ & (np.minimum(size[i + 1 :], size[i]) * 100 >= np.maximum(size[i + 1 :], size[i]) * similarity))
        after = after[np.bitwise_count(sketch[after] ^ sketch[i]).sum(1, dtype=np.int64) <= most]
        # a pair that shares several bands is checked in the first of them only
        after = after[bands[i][(bands[after] == bands[i]).argmax(1)] == key] if len(after) else after
        if len(after):
            yield i, after


def _sorted_places(rows: DataFrame) -> DataFrame:
    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE)


def open_members(rest: DataFrame, similarity: int) -> DataFrame:
    """The rows of rest that have a pair to check in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _places(batches):
            ends = [np.append(after, i) for i, after in _open_pairs(rows, similarity)]
            if ends:
                yield from rows.take(pa.array(np.unique(np.concatenate(ends)))).combine_chunks().to_batches()

    return _sorted_places(rest).mapInArrow(run, rest.schema)


def joining_links(members: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b), verified on full sets, that join components in a place. members: rows of open_members with their texts.

    Every pair that open_members saw is checked, unless links found before have joined its components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _places(batches):
            fps, texts = (rows.column(c).to_pylist() for c in ("fp", "text"))
            root = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()
            sets, found = [None] * len(fps), []
            for i, after in _open_pairs(rows, similarity):
                for j in after.tolist():
                    if root[i] == root[j]:
                        continue
                    for k in (i, j):
                        if sets[k] is None:
                            sets[k], texts[k] = shingles(texts[k]), None
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                        found.append((fps[i], fps[j]))
                        root[root == root[j]] = root[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return _sorted_places(members).mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets have the similarity. texts: (fp, text) of the classes concerned."""
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last:
                    last, of_last = b, shingles(text_b)
                one = shingles(text_a)
                common = len(np.intersect1d(one, of_last, assume_unique=True))
                if 100 * common >= similarity * (len(one) + len(of_last) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: the component's smallest id, which alone is kept.

    similarity: of a hundred, what links two documents.
    """
    return _grouped(docs, id_col, text_col, similarity).drop("text_key")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component, and every row without an id."""
    stay = _grouped(docs, id_col, text_col, similarity).where("kept and doc_id is not null").select("doc_id", "text_key").distinct()
    # the row is kept whole beside its keys, so that no name of its columns can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    named = keyed.join(stay, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    named = named.unionByName(keyed.where("doc_id is null"))
    return named.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: int) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(signatures(docs, similarity=similarity), "signatures")
    classes = materialize(
        rows.where("fp is not null and doc_id is not null").groupBy("fp")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"),
             F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")
    facts = classes.select("fp", "n_shingles", "sketch")
    members = classes.select("fp", F.explode("bands").alias("key"))
    # the least members under a few orders; an aggregate of fixed size, whatever a band holds
    hubs = F.array(*(F.min(F.struct(F.xxhash64("fp", F.lit(i)).alias("at"), "fp"))["fp"] for i in range(HUBS)))
    shared = materialize(members.groupBy("key").agg(hubs.alias("hubs"), F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialize(members.join(shared.select("key", "hubs"), "key"), "members")

    def texts_of(needed: DataFrame) -> DataFrame:
        """(fp, text) of classes: one shuffle of the documents."""
        needed = needed.distinct().join(classes.select("fp", "rep.doc_id", "rep.text_key"), "fp")
        # ids may repeat: the digest tells which row's text it is
        own = docs.join(needed, "doc_id").where(F.md5(F.coalesce("text", F.lit(""))) == F.col("text_key"))
        return materialize(own.select("fp", "text").dropDuplicates(["fp"]), "texts")

    stars = members.select(F.col("fp").alias("a"), F.explode(F.array_distinct("hubs")).alias("b")).where("a <> b").distinct()
    stars = materialize(
        stars.join(facts.alias("x"), F.col("a") == F.col("x.fp")).join(facts.alias("y"), F.col("b") == F.col("y.fp"))
        .where(_alike("x", "y", similarity)).select("a", "b", _differ("x", "y").alias("differ")), "stars")
    texts = texts_of(stars.select(F.explode(F.array("a", "b")).alias("fp")))
    links, tried, joined = None, None, None
    for _ in range(ROUNDS):
        open_ = stars
        if joined is not None:
            of_a, of_b = (joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
            open_ = stars.join(tried, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
            open_ = open_.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        best = materialize(open_.groupBy("a").agg(F.min(F.struct("differ", "b"))["b"].alias("b")), "best")
        found = materialize(verified(best, texts, similarity), "links")
        tried, links = (best, found) if links is None else (tried.union(best), links.union(found))
        joined = components(links)

    of = members.select("key", "fp").join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    of = of.withColumn("component", F.coalesce("component", "fp"))
    mixed = of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    mixed = materialize(mixed.select("key", F.ceil(F.col("n") / PART).cast("int").alias("blocks")), "mixed")
    rest = of.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rest = rest.join(classes.select("fp", "n_shingles", "sketch", "bands"), "fp").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "fp", "component", "n_shingles", "sketch", "bands")
    across = materialize(open_members(rest, similarity), "across")
    if across.limit(1).count():
        members = across.join(texts_of(across.select("fp")), "fp").select(*across.columns, "text")
        joined = components(links.union(materialize(joining_links(members, similarity), "links")))

    whole = classes.select("fp", F.col("rep.doc_id").alias("rep")).join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    whole = whole.withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = whole.join(least, "component").select("fp", "component_id")
    rows = rows.select("doc_id", "n_shingles", "fp", "text_key")
    return rows.join(whole, "fp", "left").select(
        "doc_id", "n_shingles", "text_key",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))
