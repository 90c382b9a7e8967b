"""Language identification of words by a linear-chain conditional random field.

Each word of letters (of a run of more than LONGEST letters, each piece of so many) is described by hashed features: affixes, character
n-grams and the word itself (the lexicon). Their learned weights, and learned weights of passing from one language to the next, give every word
of a text a distribution over languages by forward-backward, so that code-switched text is labelled word by word. A document takes the language
with the largest share; its score is that share.

The model is fitted on the driver to a bounded sample: at most SAMPLE windows of WINDOW words, about as many of each
language, one from a document. Half of the training sequences join windows of two languages, as switches are rare in labelled
documents. Texts are labelled whole: forward-backward runs over blocks of words in lock-step, exact across blocks.

Defined results: `und` with score 0 for a text that is null or has no letter, or where nothing could be learned; rows with a
null id or language are not learned from; null or repeated ids are labelled row by row; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_chunks

UNKNOWN = "und"
SAMPLE = 12_000
WINDOW = 24
BITS = 17
FEATURES = 1 << BITS
#: The lengths of n-grams, and the most letters of a word: a longer run of letters is several words, each labelled.
GRAMS = (2, 3, 4)
LONGEST = 40
EPOCHS = 3
BATCH = 256
BLOCK = 32
#: Words a worker remembers before it starts afresh.
REMEMBERED = 300_000

_MIX, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case; a longer run makes successive words of LONGEST letters."""
    return [w for w in _LETTERS.findall(text.lower()) if any(map(str.isalpha, w))]


@dataclass
class Features:
    """The hashed features of some words, FEATURES where there is none.

    grams has a row for each letter and boundary mark: the n-grams of 2, 3 and 4 that start there. Those with a mark are
    the affixes of up to three letters. starts says where a word's rows begin; whole is the word itself.
    """

    grams: np.ndarray
    starts: np.ndarray
    whole: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Features:
        cut = [f"^{w[:LONGEST]}$" for w in words]
        codes = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # letters to the word's end
        grams, rolled = np.full((len(codes), len(GRAMS)), FEATURES, np.int64), codes
        for n in range(2, GRAMS[-1] + 1):
            # what is rolled in past the last word's end belongs to grams that are not kept
            rolled = rolled * _MIX + np.append(codes[n - 1 :], np.zeros(n - 1, np.uint64))[: len(codes)]
            if n in GRAMS:
                at = np.flatnonzero(left >= n)
                grams[at, GRAMS.index(n)] = (rolled[at] * _MIX + np.uint64(n)) * _SPREAD >> np.uint64(64 - BITS)
        whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in words), np.int64, len(words))
        return cls(grams, starts, whole)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The summed weights (FEATURES + 1 rows, the last one zero) of each word's features."""
        each = weights[self.grams[:, 0]]
        for k in range(1, len(GRAMS)):
            each = each + weights[self.grams[:, k]]
        return (np.add.reduceat(each, self.starts) + weights[self.whole]).astype(np.float64)

    def spread(self, of_word: np.ndarray) -> np.ndarray:
        """The transpose of sums: for each feature the sum over the words that have it."""
        sizes = np.diff(np.append(self.starts, len(self.grams)))
        return np.bincount(self.grams.ravel(), np.repeat(of_word, sizes * len(GRAMS)), FEATURES + 1) + np.bincount(self.whole, of_word, FEATURES + 1)


@dataclass
class Model:
    """labels, weights (FEATURES + 1 x labels, the last row zero), switches (labels x labels) and start (labels)."""

    labels: list[str]
    weights: np.ndarray
    switches: np.ndarray
    start: np.ndarray
    number: dict[str, int] = field(default_factory=dict)  # word -> its number, -1 without a letter
    scores: np.ndarray | None = None  # by a word's number

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": {}, "scores": None}

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of its words, rows of self.scores."""
        if self.scores is None or len(self.number) > REMEMBERED:
            self.number, self.scores = {}, np.zeros((0, len(self.labels)))
        found = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        new = list(set().union(*found).difference(self.number))
        words = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        self.number.update(dict.fromkeys(new, -1))
        if words:
            self.number.update(zip(words, range(len(self.scores), len(self.scores) + len(words)), strict=True))
            self.scores = np.concatenate([self.scores, Features.of(words).sums(self.weights)])
        get, out = self.number.__getitem__, []
        for ws in found:
            each = np.fromiter(map(get, ws), np.int32, len(ws))
            out.append(each if each.min(initial=0) == 0 else each[each >= 0])
        return out

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(label) of each word, of texts of so many words, one after another.

        Texts are cut into blocks. A block's product of steps carries the forward vector across it and the backward
        vector back, so first those products are formed, then passed along each text, and then every block is filled in.
        """
        n_labels = len(self.labels)
        blocks = -(-sizes // BLOCK)
        total = int(blocks.sum())
        begins, firsts = np.cumsum(sizes) - sizes, np.cumsum(blocks) - blocks
        in_text = np.arange(total) - np.repeat(firsts, blocks)
        at = (np.repeat(begins, blocks) + in_text * BLOCK)[:, None] + np.arange(BLOCK)
        inside = at < np.repeat(begins + sizes, blocks)[:, None]
        e = np.exp(scores - scores.max(1, keepdims=True))
        e = np.where(inside[:, :, None], e[np.minimum(at, len(e) - 1)], 1.0)
        still = ~inside
        still[firsts, 0] = True  # no step leads to a text's first word, or past its last
        step = np.exp(self.switches - self.switches.max())
        product = np.tile(np.eye(n_labels), (total, 1, 1))
        for t in range(BLOCK):
            product = np.where(still[:, t, None, None], product, product @ step) * e[:, t, None, :]
            product /= product.max((1, 2), keepdims=True)
        ahead, back = np.empty((total, n_labels)), np.ones((total, n_labels))
        ahead[firsts] = np.exp(self.start - self.start.max())
        for k in range(1, int(blocks.max())):
            b = firsts[blocks > k] + k
            v = np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1])
            ahead[b] = v / v.max(1, keepdims=True)
        for k in range(int(blocks.max()) - 1, 0, -1):
            b = firsts[blocks > k] + k
            v = np.einsum("bij,bj->bi", product[b], back[b])
            back[b - 1] = v / v.max(1, keepdims=True)
        forward = np.empty((total, BLOCK, n_labels))
        v = ahead
        for t in range(BLOCK):
            v = np.where(still[:, t, None], v, v @ step) * e[:, t]
            v = v / v.max(1, keepdims=True)
            forward[:, t] = v
        v = back
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= v
            v = v * e[:, t]
            v = np.where(still[:, t, None], v, v @ step.T)
            v = v / v.max(1, keepdims=True)
        forward /= forward.sum(2, keepdims=True)
        return forward[inside]

    def label(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text the marginals of its words (words x labels)."""
        found = self.numbers(texts)
        sizes = np.array([len(f) for f in found])
        full = sizes > 0
        if not full.any():
            yield from (np.zeros((0, len(self.labels))) for _ in texts)
            return
        each = self.marginals(self.scores[np.concatenate(found)], sizes[full])
        ends = np.cumsum(sizes).tolist()
        yield from (each[a:b] for a, b in zip([0, *ends], ends, strict=False))


def fit(sequences: list[tuple[list[str], list[int]]], labels: list[str], epochs: int = EPOCHS) -> Model:
    """Weights that make the labels of sequences (words, label numbers) likely, by adaptive gradient steps."""
    n = len(labels)
    model = Model(labels, np.zeros((FEATURES + 1, n), np.float32), np.zeros((n, n)), np.zeros(n))
    sums = [np.full_like(x, 1e-6, dtype=np.float64) for x in (model.weights, model.switches, model.start)]
    rng = random.Random(7)
    for _ in range(epochs):
        rng.shuffle(sequences)
        for k in range(0, len(sequences), BATCH):
            batch = sequences[k : k + BATCH]
            words = list({w: None for s, _ in batch for w in s})
            number = dict(zip(words, range(len(words)), strict=True))
            sizes = np.array([len(s) for s, _ in batch])
            features = Features.of(words)
            scores = features.sums(model.weights)
            wide = int(sizes.max())
            ids, gold = np.zeros((len(batch), wide), int), np.full((len(batch), wide), -1)
            for i, (s, y) in enumerate(batch):
                ids[i, : len(s)], gold[i, : len(s)] = [number[w] for w in s], y
            single, double = _expected(model, scores[ids], sizes)
            truth = (gold[:, :, None] == np.arange(n)).astype(float)
            error = truth - single * (gold >= 0)[:, :, None]
            pairs = np.zeros((n, n))
            both = (gold[:, :-1] >= 0) & (gold[:, 1:] >= 0)
            np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            by_word = np.stack([np.bincount(ids.ravel(), error[:, :, j].ravel(), len(words)) for j in range(n)], 1)
            grad = np.stack([features.spread(by_word[:, j]) for j in range(n)], 1)
            grad[FEATURES] = 0
            grads = (grad, pairs - double, error[:, 0].sum(0))
            for x, g, s, rate in zip((model.weights, model.switches, model.start), grads, sums, (0.2, 0.1, 0.1), strict=True):
                s += g * g
                x += (rate * g / np.sqrt(s)).astype(x.dtype)
    return model


def _expected(model: Model, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each word of padded sequences, and the expected number of each passage."""
    count, wide, n = scores.shape
    e, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(model.switches - model.switches.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    v = np.exp(model.start - model.start.max()) * e[:, 0]
    alpha[:, 0] = v / v.sum(1, keepdims=True)
    for t in range(1, wide):
        v = (alpha[:, t - 1] @ step) * e[:, t]
        alpha[:, t] = v / v.sum(1, keepdims=True)
    double = np.zeros((n, n))
    for t in range(wide - 2, -1, -1):
        right = e[:, t + 1] * beta[:, t + 1]
        v = right @ step.T
        inside = (t + 1 < sizes)[:, None]
        beta[:, t] = np.where(inside, v / v.sum(1, keepdims=True), 1.0)
        pair = alpha[:, t, :, None] * step * right[:, None, :]
        double += (pair / pair.sum((1, 2), keepdims=True))[inside[:, 0]].sum(0)
    both = alpha * beta
    return both / both.sum(2, keepdims=True), double


def sequences_from(windows: list[tuple[str, list[str]]], labels: list[str]) -> list[tuple[list[str], list[int]]]:
    """Training sequences: each window by itself or, half the time, joined with part of one in another language."""
    rng, number = random.Random(5), {x: i for i, x in enumerate(labels)}
    out = []
    for lang, words in windows:
        other, more = windows[rng.randrange(len(windows))]
        if rng.random() < 0.5 and other != lang:
            a, b = words[: rng.randint(1, len(words))], more[: rng.randint(1, len(more))]
            out.append((a + b, [number[lang]] * len(a) + [number[other]] * len(b)))
        else:
            out.append((words, [number[lang]] * len(words)))
    return out


def learn(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a sample of labelled rows, chosen by a hash of the id; None if there is nothing to learn from."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (chance < share / n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                at = zlib.crc32(f"window {key}".encode()) % max(1, len(words) - WINDOW + 1)
                if words:
                    out.append((lang, words[at : at + WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["lang", "words"])

    found = rows.where(wanted).mapInArrow(cut, "lang string, words array<string>").limit(2 * sample).collect()
    windows = sorted((r["lang"], list(r["words"])) for r in found)
    labels = sorted({lang for lang, _ in windows})
    return fit(sequences_from(windows, labels), labels) if labels else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; with runs, also the stretches of words of one language.

    runs: array of (lang, n_words), by the likeliest language of each word.
    """
    return _predict(docs, model, F.col(id_col).alias("doc_id"), F.col(text_col), runs)


def screen(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are in a known language with at least so high a score."""
    rows = _predict(docs, model, F.struct("*").alias("_row"), F.col(text_col), False)
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")


def _predict(docs: DataFrame, model: Model | None, first: Column, text: Column, runs: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    shape = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for at, texts in text_chunks([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(1)], ["at", "text"])]):
                langs, scores, stretches = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                for i, each in enumerate(model.label(texts)) if model else ():
                    if len(each):
                        mean = each.mean(0)
                        langs[i], scores[i] = model.labels[int(mean.argmax())], min(1.0, float(mean.max()))
                        if runs:
                            best = each.argmax(1)
                            cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
                            stretches[i] = [{"lang": model.labels[best[a]], "n_words": b - a} for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [batch.column(0).slice(done, len(at)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                done += len(at)
                names = [batch.schema.names[0], "lang_pred", "score"]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(stretches, shape)] if runs else columns, [*names, "runs"] if runs else names)

    docs = docs.select(first, text.alias("text"))
    fields = [docs.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if runs:
        run_type = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())])
        fields.append(T.StructField("runs", T.ArrayType(run_type)))
    return docs.mapInArrow(run, T.StructType(fields))


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: the CRC-32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
