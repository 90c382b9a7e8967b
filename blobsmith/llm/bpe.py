"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the ranks of the pairs that start at each symbol; an inner node holds the least rank below it.
The root says whether a merge is left, and going down to the left on ties finds the leftmost pair of the lowest rank. A
merge changes three leaves, each put right in a logarithmic number of steps.

Words of similar length are merged in lock-step: their trees are the rows of one numpy array. Very long words take the
plain one-tree form. Text is split at blanks first, so that a worker meets each spelling once and keeps its ids in a
bounded table; nothing in the tokenizer's rules joins what a blank divides.

Defined results: a null text encodes as no ids, like an empty one; null or repeated ids of documents are kept row by row;
other columns are ignored; null ids decode as an empty text. Special tokens in a text become their ids, and decoding
keeps them. A file of another kind (other pre-tokenizer, normalizer or decoder) is refused.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, text_chunks

NONE = np.int32(2**31 - 1)
#: What Unicode calls white space, for a pattern's brackets. Python's own class has more.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words a worker remembers before it starts afresh, and half of the spellings.
REMEMBERED = 300_000
#: Words with more pairs than this are merged one by one.
LOCKSTEP_PAIRS = 128


class Vocabulary:
    """The merge ranks and spellings of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not end or spec.get("decoder") or split["behavior"] != "Removed":
            raise ValueError(f"{path}: not a byte-level BPE with word ends, lower case and no decoder")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [f"{x['content']} {k}" for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
        if odd:
            raise ValueError(f"{path}: not supported: {', '.join(odd)}")
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.spelling = np.array([""] * (max([*ids.values(), *self.special.values()]) + 1), object)
        for text, i in [*ids.items(), *self.special.items()]:
            self.spelling[i] = text
        self.words = re.compile(split["pattern"]["Regex"].replace(r"\s", BLANKS).replace(r"\p{L}", of_class("L")).replace(r"\p{N}", of_class("N")))
        self.specials = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.strange = re.compile(f"[{of_class('Cn')}]")
        self.library = Tokenizer.from_file(path)
        self.letters = letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + end] for c in letters], np.int32)
        pairs = [(p.split(" ") if isinstance(p, str) else p) for p in model["merges"]]
        self.size = len(self.spelling)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.strange.search(text):  # newer than Python's tables of characters, but perhaps not than the library's
            parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.letters.index, word)).decode() for word, _ in parts]
        plain = unicodedata.normalize("NFC", text)
        # letter by letter, as the lower case of one letter depends on its place
        return self.words.findall("".join(map(str.lower, plain)) if "Σ" in plain else plain.lower())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where no merge is known."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@functools.cache
def of_class(letter: str) -> str:
    """The ranges, for a pattern's brackets, of the characters of a Unicode category (a letter: all that start so)."""
    inside = np.fromiter((unicodedata.category(chr(c)).startswith(letter) for c in range(sys.maxunicode + 1)), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next free letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merge_one(vocab: Vocabulary, word: bytes) -> list[int]:
    """The ids of one word by one tree in plain Python."""
    n = len(word)
    codes = np.frombuffer(word, np.uint8)
    sym = vocab.inner[codes].tolist()
    sym[-1] = int(vocab.last[codes[-1]])
    if n == 1:
        return sym
    cap = 1 << max(0, n - 2).bit_length()
    none, known, size, made = int(NONE), vocab.rank_of, vocab.size, vocab.made
    tree = [none] * (2 * cap)
    for i in range(n - 1):
        tree[cap + i] = known.get(sym[i] * size + sym[i + 1], none)
    for k in range(cap - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = cap + i
        tree[k] = rank
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least and k < cap // 2:
                break
            tree[k] = least

    while (rank := tree[1]) != none:
        k = 1
        while k < cap:
            k = 2 * k if tree[2 * k] == rank else 2 * k + 1
        i = k - cap
        j = after[i]
        right, left = after[j], before[i]
        sym[i], sym[j], after[i] = int(made[rank]), -1, right
        if j < n - 1:
            put(j, none)
        if right < n:
            before[right] = i
            put(i, known.get(sym[i] * size + sym[right], none))
        else:
            put(i, none)
        if left >= 0:
            put(left, known.get(sym[left] * size + sym[i], none))
    return [s for s in sym if s >= 0]


def merge_many(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids, as little-endian 32-bit integers, of words of at most LOCKSTEP_PAIRS pairs, merged in lock-step.

    Row r of the (flat) arrays is the tree and the symbols of word r; `live` are the rows with a merge left.
    """
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    cap = 1 << max(0, int(sizes.max()) - 2).bit_length()
    depth, wide = cap.bit_length() - 1, cap + 2
    row, col = np.repeat(np.arange(n), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sym = np.full(n * wide, -1, np.int32)
    sym[row * wide + col] = vocab.inner[np.frombuffer(b"".join(words), np.uint8)]
    sym[np.arange(n) * wide + sizes - 1] = vocab.last[np.fromiter((w[-1] for w in words), np.int64, n)]
    square = np.full((n, 2 * cap), NONE, np.int32)
    inside = col < sizes[row] - 1
    r, c = row[inside], col[inside]
    square[r, cap + c] = vocab.rank(sym[r * wide + c], sym[r * wide + c + 1])
    half = cap // 2
    while half:
        np.minimum(square[:, 2 * half : 4 * half : 2], square[:, 2 * half + 1 : 4 * half : 2], out=square[:, half : 2 * half])
        half //= 2
    tree = square.reshape(-1)
    after = np.tile(np.arange(1, wide + 1), n)
    before = np.tile(np.arange(-1, wide - 1), n)
    live = np.flatnonzero(square[:, 1] != NONE)
    while len(live):
        root, at = live * (2 * cap), live * wide
        rank = tree[root + 1]
        node = np.ones(len(live), np.int64)
        for _ in range(depth):
            node *= 2
            node += tree[root + node] != rank
        i = node - cap
        j = after[at + i]
        right, left = after[at + j], before[at + i]
        made = vocab.made[rank]
        sym[at + i] = made
        sym[at + j] = -1
        after[at + i] = right
        before[at + right] = i
        gone = np.flatnonzero(j < cap)
        tree[root[gone] + cap + j[gone]] = NONE
        some = np.flatnonzero(left >= 0)
        ranks = vocab.rank(
            np.concatenate([made, sym[at[some] + left[some]]]), np.concatenate([sym[at + right], made[some]]))
        tree[root + node] = ranks[: len(live)]
        tree[root[some] + cap + left[some]] = ranks[len(live) :]
        roots = np.concatenate([root, root[gone], root[some]])
        path = np.concatenate([node, cap + j[gone], cap + left[some]])
        for _ in range(depth):
            path >>= 1
            child = roots + 2 * path
            tree[roots + path] = np.minimum(tree[child], tree[child + 1])
        live = live[tree[root + 1] != NONE]
    kept = sym.reshape(n, wide) >= 0
    ids = sym.reshape(n, wide)[kept].astype("<i4").tobytes()
    ends = (4 * np.cumsum(kept.sum(1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Ids of texts, with a bounded memory of words and of the spellings between blanks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def pieces(self, text: str) -> list[str | int]:
        """The words and special ids of what stands between two blanks."""
        out, at = [], 0
        found = self.vocab.specials.finditer(text)
        for part, special in [*((m.span(), self.vocab.special[m[0]]) for m in found), ((len(text), len(text)), None)]:
            out += self.vocab.split(text[at : part[0]])
            out += [] if special is None else [special]
            at = part[1]
        return out

    def learn(self, tokens: list[bytes]) -> None:
        """Remember the ids of spellings not met before."""
        # what is all letters (but for the letter whose lower case depends on its place) is one word
        texts = b"\n".join(tokens).decode()
        plain = unicodedata.normalize("NFC", texts).lower().split("\n")
        split, strange = self.vocab.words.findall, self.vocab.strange.search("".join(set(texts)))

        def plainly(p: str) -> bool:
            return not strange and "ς" not in p and "<" not in p

        clear = [p.isascii() and "<" not in p or plainly(p) for p in plain]
        single = [c and p.isalpha() for c, p in zip(clear, plain, strict=True)]
        alone, words = list(compress(tokens, single)), list(compress(plain, single))
        rest = [
            (token, split(p) if c else self.pieces(token.decode()))
            for token, p, c, s in zip(tokens, plain, clear, single, strict=True) if not s
        ]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = {w for _, parts in rest for w in parts if isinstance(w, str)}.union(words).difference(self.words)
        self.merge(sorted(map(str.encode, new), key=len))
        ids, specials = self.words, {i: i.to_bytes(4, "little") for i in self.vocab.special.values()}
        self.known.update(zip(alone, map(ids.__getitem__, words), strict=True))
        self.known.update((token, b"".join([ids[w] if isinstance(w, str) else specials[w] for w in parts])) for token, parts in rest)

    def merge(self, words: list[bytes]) -> None:
        """Remember the ids of words, which come by length."""
        at = 0
        while at < len(words):
            n = len(words[at])
            if n - 1 > LOCKSTEP_PAIRS:
                self.words[words[at].decode()] = np.array(merge_one(self.vocab, words[at]), np.int32).tobytes()
                at += 1
                continue
            cap = 1 << max(0, n - 2).bit_length()
            end = at
            while end < len(words) and len(words[end]) - 1 <= cap and end - at < max(1, 200_000 // cap):
                end += 1
            self.words.update(zip(map(bytes.decode, words[at:end]), merge_many(self.vocab, words[at:end]), strict=True))
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        tokens = [(t or "").encode().split() for t in texts]
        if len(self.known) > 2 * REMEMBERED:
            self.known.clear()
        if new := list(set().union(*tokens).difference(self.known)):
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, t)) for t in tokens]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process; it stays for the next task."""
    return Encoder(Vocabulary(path))


def id_lists(encoded: list[bytes]) -> pa.Array:
    """An array<int> column from packed ids."""
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text under the tokenizer file at path, a path on each machine."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), id_lists(encoder(path).encode(texts))], ["doc_id", "ids"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = arrow_type(docs, "doc_id")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text: the spellings of the ids of a row of encode(), one blank between them, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            spelt = encoder(path).vocab.spelling[lists.flatten().to_numpy(zero_copy_only=False)].tolist()
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            texts = [" ".join(spelt[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column of df."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)

