"""Language-model scores by prediction by partial matching over bytes.

The trie of contexts is a set of tables, one for each order: how often a byte followed a context in the training texts.
A byte is coded in its longest known context; if it never followed there, an escape is coded (method D: each different byte
that did follow gives half a count to the escape) and the next shorter context is tried, in which the bytes of the longer
one are excluded, as the escape has ruled them out. Below the highest order a byte counts once for each longer context
it followed (update exclusion). Below order 0 all bytes not yet excluded are equally likely. An end of
text is coded too, so the scores are log10 probabilities of whole texts.

Since the model is fixed once learned, the cost of a byte depends on its context alone, so it is worked out once for each
different gram of a context and a byte. A task gathers its texts into chunks; a chunk's different grams and words meet the
tables by joins and windows and come back to its (compressed) texts in a cogroup, so nothing that grows with the corpus is collected
or broadcast.

Lower case is used throughout (A-Z only). Defined results: a null text is empty; a row without an id is scored, not
learned from, and not held out; repeated ids are scored row by row; other columns are ignored; without training texts
every byte costs the same and the base score is that of unknown words. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import arrow_type
from .common import materialize, small_batches, text_chunks

ORDER = 5
#: Text of a chunk, in bytes, and its different grams: a chunk ends once it has so many. A longer text makes a chunk of its own.
CHUNK, DIFFERENT = 32_000_000, 2_000_000
#: Bytes of text unpacked at a time.
PIECE = 6_000_000
#: Never part of UTF-8: stands for the end of a text and, ORDER times, for what is before it.
EDGE = b"\xff"
SYMBOLS = 256
#: The end of a text among words; no word holds a blank.
END = " "
#: Grams handled at a time, rows sent at a time, and rows in loose parts that are not worth a merge.
_STEP, SENT, LOOSE = 1 << 18, 1 << 16, 1 << 18


def gram_blocks(texts: list[bytes], step: int = _STEP) -> Iterator[tuple[int, np.ndarray]]:
    """The grams of ORDER + 1 bytes of texts, one for each byte and the end of each, in order, in blocks of about `step`.

    Each block comes with the number of grams before it.
    """
    joined = np.frombuffer(b"".join(EDGE * ORDER + t + EDGE for t in texts), np.uint8)
    n = len(joined) - ORDER
    starts = _starts(texts)
    inside = np.ones(n, bool)
    between = starts[1:] + ORDER * np.arange(len(texts) - 1)
    inside[(between[:, None] + np.arange(ORDER)).ravel()] = False
    done = 0
    for a in range(0, n, step):
        b = min(n, a + step)
        out = np.zeros(b - a, np.int64)
        for i in range(ORDER + 1):
            out <<= 8
            out |= joined[a + i : b + i]
        out = out[inside[a:b]]
        yield done, out
        done += len(out)


def _starts(texts: list[bytes]) -> np.ndarray:
    """How many grams come before each text's."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.cumsum(sizes) - sizes


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different one of sorted grams once, with the sum of its n."""
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(n, first)


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = parts.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)  # a blank at either end leaves an empty part
    inside = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy()
    return words.filter(full), np.diff(inside[offsets])


class Chunk:
    """The different words and grams of some texts, and how often they are in training texts.

    New parts are merged into one once they outgrow it, so a chunk holds its different words and grams about twice at most.
    """

    def __init__(self) -> None:
        self.size, self.ends = 0, 0
        self.words: list[tuple[pa.Array, np.ndarray]] = []
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], learned: list[bool]) -> None:
        words, sizes = split_words(texts)
        flags = np.array(learned, bool)
        self.words.append(_counted(words, np.repeat(flags, sizes)))
        if _outgrown([len(n) for _, n in self.words]):
            self.merged_words()
        self.ends += int(flags.sum())
        self.size += sum(map(len, texts))
        each = np.repeat(flags, [len(t) + 1 for t in texts])
        for done, grams in gram_blocks(texts):
            keys = grams << 1 | each[done : done + len(grams)]
            keys.sort()
            if len(keys):
                self.grams.append(_summed(keys >> 1, keys & 1))
            if _outgrown([len(g) for g, _ in self.grams]):
                self.merged_grams()

    @property
    def full(self) -> bool:
        return self.size >= CHUNK or sum(len(g) for g, _ in self.grams) >= DIFFERENT

    def merged_words(self) -> tuple[pa.Array, np.ndarray]:
        """The different words and their counts."""
        if len(self.words) > 1:
            words, n = zip(*self.words, strict=True)
            self.words = [_counted(pa.concat_arrays(words), np.concatenate(n))]
        return self.words[0]

    def merged_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The different grams, in order, and their counts."""
        if len(self.grams) > 1:
            grams, n = (np.concatenate(x) for x in zip(*self.grams, strict=True))
            self.grams = []
            order = np.argsort(grams, kind="stable")  # merges the parts, which are in order
            self.grams = [_summed(grams[order], n[order])]
        return self.grams[0]

    def rows(self, chunk: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Its words, in order and numbered, and its grams, in batches."""
        words, n = self.merged_words()
        order = pc.array_sort_indices(words)
        names = pa.concat_arrays([words.take(order).cast(pa.string()), pa.array([END])])
        counts, places = np.append(n[order.to_numpy()], self.ends), np.arange(len(names))
        del words
        self.words = []
        for a in range(0, len(names), SENT):
            at = slice(a, a + SENT)
            yield _batch(len(places[at]), kind, chunk=chunk, place=places[at], word=names.slice(a, SENT), n=counts[at])
        grams, n = self.merged_grams()
        self.grams = []
        for a in range(0, len(grams), SENT):
            yield _batch(len(grams[a : a + SENT]), kind, chunk=chunk, gram=grams[a : a + SENT], n=n[a : a + SENT])


def _counted(words: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each different word once, with the sum of its n."""
    coded = words.dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), n, len(coded.dictionary)).astype(np.int64)


def _outgrown(sizes: list[int]) -> bool:
    """The parts after the first are more than it, and worth a merge."""
    return sum(sizes[1:]) > max(sizes[0] if sizes else 0, LOOSE)


_FIELDS = {"chunk": pa.int64(), "place": pa.int32(), "word": pa.string(), "gram": pa.int64(), "n": pa.int64(), "text": pa.binary()}


def _batch(size: int, kind: pa.DataType, **columns) -> pa.RecordBatch:  # noqa: ANN003
    """Rows of gather(): the columns given, the others null."""
    columns["chunk"] = np.full(size, columns["chunk"], np.int64)
    kinds = _FIELDS | {"doc_id": kind}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))


def gather(rows: DataFrame) -> DataFrame:
    """A table of three kinds of rows: (chunk, doc_id, text) of texts, lower-case and compressed, (chunk, place, word, n), (chunk, gram, n).

    rows: (doc_id, text, learned). place is the number of a word among those of its chunk, in order.
    """
    kind = arrow_type(rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, chunk, number = zstandard.ZstdCompressor(), Chunk(), TaskContext.get().partitionId() << 24
        for batch in batches:
            known = batch.column(2).to_pylist()
            done = 0
            for keys, texts in text_chunks([batch]):
                low = [(t or "").encode().lower() for t in texts]
                chunk.add(low, known[done : done + len(low)])
                done += len(low)
                yield _batch(len(low), kind, chunk=number, doc_id=keys, text=[pack.compress(t) for t in low])
                if chunk.full:
                    yield from chunk.rows(number, kind)
                    chunk, number = Chunk(), number + 1
        if chunk.grams:
            yield from chunk.rows(number, kind)

    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "learned").mapInArrow(
        run, f"chunk long, place int, word string, gram long, n long, text binary, doc_id {name}")


class Costs:
    """A table from grams to values: open addressing in arrays, looked up for many grams at once."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(grams)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slots, left = self._slots(grams), np.arange(len(grams))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]], self.values[slots[free]] = grams[free], values[free]
            left = left[self.keys[slots[left]] != grams[left]]
            slots[left] = slots[left] + 1 & (1 << self.bits) - 1

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        slots = self._slots(grams)
        other = np.flatnonzero(self.keys[slots] != grams)
        while len(other):
            if (self.keys[slots[other]] < 0).any():
                raise KeyError("a gram without a cost")
            slots[other] = slots[other] + 1 & (1 << self.bits) - 1
            other = other[self.keys[slots[other]] != grams[other]]
        return self.values[slots]


class Counts:
    """The counts of words, which are in order."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        self.words, self.logs, self.known = words, np.log10(counts + 0.1), counts > 0

    @classmethod
    def of(cls, texts: Iterator[list[bytes]], counts: np.ndarray) -> Counts:
        """Of the different words of texts, whose counts come in the words' order, the end last."""
        words = pa.concat_arrays([pa.array([], pa.large_string()), *(split_words(part)[0].unique() for part in texts)]).unique()
        words = words.take(pc.array_sort_indices(words))
        return cls(pa.concat_arrays([words, pa.array([END], pa.large_string())]), counts)

    def sums(self, texts: list[bytes]) -> pd.DataFrame:
        """n_tokens, n_known and log_sum of each text."""
        words, sizes = split_words(texts)
        coded = words.dictionary_encode()
        places = pc.index_in(coded.dictionary, value_set=self.words).to_numpy()[coded.indices.to_numpy()]
        out = pd.DataFrame({"n_tokens": sizes + 1, "n_known": int(self.known[-1]), "log_sum": self.logs[-1]})
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        if len(starts):
            out.loc[some, "n_known"] += np.add.reduceat(self.known[places], starts, dtype=np.int64)
            out.loc[some, "log_sum"] += np.add.reduceat(self.logs[places], starts)
        return out


def gram_sums(texts: list[bytes], costs: Costs) -> np.ndarray:
    """The summed costs of each text's grams."""
    out, starts = np.zeros(len(texts)), _starts(texts)
    for done, grams in gram_blocks(texts):
        if len(grams):
            a, b = np.searchsorted(starts, done, "right") - 1, np.searchsorted(starts, done + len(grams))
            out[a:b] += np.add.reduceat(costs.of(grams), np.maximum(starts[a:b] - done, 0))
    return out


def score_chunk(docs: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """The sums of a chunk's texts, which are unpacked piece by piece.

    facts (key, value): the count of each word, under -1 less its place, and the log10 probability of each gram.
    """
    keys, values = facts["key"].to_numpy(), facts["value"].to_numpy()
    is_word = keys < 0
    counts = np.full(int(is_word.sum()), np.nan)
    counts[-1 - keys[is_word]] = values[is_word]
    costs = Costs(keys[~is_word], values[~is_word])
    del keys, values, is_word
    packed = docs["text"].to_numpy()

    def pieces() -> Iterator[list[bytes]]:
        unpack, piece, size = zstandard.ZstdDecompressor(), [], 0
        for t in packed:
            piece.append(unpack.decompress(t))
            size += len(piece[-1])
            if size >= PIECE:
                yield piece
                piece, size = [], 0
        if piece:
            yield piece

    known = Counts.of(pieces(), counts)
    sums = pd.concat([known.sums(p).assign(score=gram_sums(p, costs)) for p in pieces()], ignore_index=True)
    return sums.assign(doc_id=docs["doc_id"].to_numpy())


def trie(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables for the orders 0..order, from the counts (gram, n) of the highest.

    followers[k]: (gram, n); contexts[k]: (context, total, kinds, excl_total, excl_kinds). The last two are what the parent
    context is left with, of total and of different bytes, once the context's own bytes are excluded.
    """
    followers = [counts.where("n > 0")]
    for k in range(order - 1, -1, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        # written out, as each table is read by several others
        followers.insert(0, materialize(followers[0].groupBy(low.alias("gram")).agg(F.count("*").alias("n")), "followers"))
    contexts = []
    for k, table in enumerate(followers):
        stats = table.withColumn("context", F.shiftright("gram", 8))
        if k == 0:
            own = stats.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            own = own.withColumn("excl_total", F.lit(0).cast("long")).withColumn("excl_kinds", SYMBOLS - F.col("kinds"))
            contexts.append(materialize(own, "contexts"))
            continue
        low = F.lit((1 << 8 * k) - 1)
        parent = followers[k - 1].select(F.col("gram").alias("low"), F.col("n").alias("parent_n"))
        own = stats.withColumn("low", F.col("gram").bitwiseAND(low)).join(parent, "low").groupBy("context").agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("parent_n").alias("taken"))
        above = contexts[k - 1].select(F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
        own = own.withColumn("up", F.col("context").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(above, "up")
        own = own.select(
            "context", "total", "kinds", (F.col("up_total") - F.col("taken")).alias("excl_total"),
            (F.col("up_kinds") - F.col("kinds")).alias("excl_kinds"))
        contexts.append(materialize(own, "contexts"))
    return followers, contexts


def gram_costs(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, value): the log10 probability of each gram's last byte after the bytes before it. grams: (gram, n)."""
    followers, contexts = trie(grams, order)
    nothing = F.lit(None).cast("long")
    rows = grams.select("gram", F.lit(0.0).alias("value"), nothing.alias("left_total"), nothing.alias("left_kinds"))
    done = None
    for k in range(order, -1, -1):
        seen = followers[k].select(F.col("gram").alias("low"), F.col("n").alias("found"))
        rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)))
        rows = rows.withColumn("context", F.shiftright("low", 8)).join(seen, "low", "left").join(contexts[k], "context", "left")
        plain = F.col("left_total").isNull()
        escape = F.when(plain, F.col("kinds")).otherwise(F.col("left_kinds"))
        total = 2 * F.when(plain, F.col("total")).otherwise(F.col("left_total"))
        coded = F.coalesce(2 * F.col("found") - 1, escape)
        # an unknown context, or one with no byte left, costs nothing
        step = F.when(F.col("total").isNull() | (total == 0), F.lit(0.0)).otherwise(F.log10(coded / total))
        rows = rows.select(
            "gram", (F.col("value") + step).alias("value"), F.col("found").isNotNull().alias("coded"),
            F.coalesce("excl_total", "left_total").alias("left_total"), F.coalesce("excl_kinds", "left_kinds").alias("left_kinds"))
        rows = materialize(rows, "costs")
        ended = rows.where("coded").select("gram", "value")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where("not coded").drop("coded")
    rest = F.log10(F.coalesce("left_kinds", F.lit(SYMBOLS)).cast("double"))
    return done.unionByName(rows.select("gram", (F.col("value") - rest).alias("value")))


def score(docs: DataFrame, learned: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    learned and held_out: conditions on doc_id. base_score is the smoothed unigram score of words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialize(gather(rows.withColumn("learned", F.coalesce(learned, F.lit(False)))), "counts")
    words, grams = counts.where("word is not null"), counts.where("gram is not null")
    # a word has a row for each chunk at most, so its rows are few and sum in place
    same, in_order = Window.partitionBy("word"), Window.partitionBy("word").orderBy("chunk")
    words = materialize(words.select(
        "chunk", "place", "n", F.sum("n").over(same).alias("value"), (F.row_number().over(in_order) == 1).alias("first")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("first") & (F.col("value") > 0)).alias("kinds")).first()
    of_gram = materialize(gram_costs(materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")), "costs")
    facts = words.select(F.col("chunk").alias("of_chunk"), (-1 - F.col("place")).cast("long").alias("key"), F.col("value").cast("double").alias("value")).unionByName(
        grams.select("chunk", "gram").join(of_gram, "gram").select(F.col("chunk").alias("of_chunk"), F.col("gram").alias("key"), "value"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = counts.where("text is not null").select("chunk", "doc_id", "text").groupBy("chunk").cogroup(facts.groupBy("of_chunk")).applyInPandas(
        score_chunk, f"n_tokens long, n_known long, log_sum double, doc_id {kind}, score double")
    floor = math.log10(total["tokens"] + 0.1 * (total["kinds"] + 1))
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(total["tokens"]).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * floor).alias("base_score"), "score")
