"""Personal data: fixed shapes, and identifiers found by bootstrapped contextual extraction.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by their shape. These seeds induce lexical
patterns: the words before and after them, and single words further to the left. Other things that look like identifiers (words with a digit or
an @, numbers written with blanks, addresses with (at)) are met in patterns too. Spark scores the graph of patterns and
instances in turns: a pattern is as good as the share of known instances of a kind among all it introduces, where one that is
unknown but could be of the kind counts UNKNOWN only, and must beat the share of that kind among all instances; an instance is
as good as its patterns together. Patterns that stay confident then point out identifiers that the shapes missed.

Defined results: a null text is empty and has no spans; null or repeated ids are handled row by row; other columns are
ignored by find and kept by redact, whatever their names; an empty table gives an empty result. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import arrow_type
from .common import materialize, small_batches, spread_join

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring, and what a pattern needs: known instances that differ, the share of them, and the standard deviations by which it beats chance.
TURNS = 3
SUPPORT = 5
CONFIDENCE = 0.8
BEYOND = 2.0
#: What an instance that could be of a kind counts against a pattern.
UNKNOWN = 0.2
#: Words of context: those to the left that may be a cue, and the characters by which a word is known (the nearest ones).
CUES = 4
NEAREST = 40
#: Rows with spans found by context, and spans of each, that are broadcast to the texts; with more of either the texts are shuffled.
FEW, FEW_SPANS = 100_000, 100
#: What an instance found by context must look like to be of a kind, in full.
SHAPES = {
    "email": re.compile(r"[^@\s]+\s?(?:@|\(at\)|\[at\])\s?[^@\s]+"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,:][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){11,18}"),
    "phone": re.compile(r"\+?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}"),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot start within a run of digits whose start fails: what follows the run is the same
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")
_WORD = re.compile(r"\S+")
_NUMERIC = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*")
_AT = ("(at)", "[at]")
_EDGES = ".,;:!?\"'<>[]{}"
_NOT_DIGITS = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each has one @, so it is found from its @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what has a known shape, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) < 4 and int(q or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def could_be(instance: str) -> int:
    """The kinds whose loose shape an instance has, a bit each."""
    return sum(1 << k for k, name in enumerate(KINDS) if SHAPES[name].fullmatch(instance))


def patterns_of(text: str, words: list[tuple[int, int]], first: int, last: int, start: int, stop: int) -> list[str]:
    """The patterns of what lies from start to stop, within the words numbered first to last.

    They are the word before and the two before, the word after and the two after, both neighbours, and each of the CUES words before. What
    the first word has before start counts as a word, as does what the last has after stop; ^ and $ are the ends of the text.
    """
    left = [text[max(a, b - NEAREST) : b] for a, b in words[max(0, first - CUES) : first]]
    if words[first][0] < start:
        left.append(text[max(words[first][0], start - NEAREST) : start])
    right = [text[stop : min(words[last][1], stop + NEAREST)]] if stop < words[last][1] else []
    right += [text[a : min(b, a + NEAREST)] for a, b in words[last + 1 : last + 3]]
    left, right = ([_DIGIT.sub("0", w.lower()) for w in side] for side in (["^", "^", *left], [*right, "$", "$"]))
    near, after = left[-1], right[0]
    out = [f"l1 {near}", f"l2 {left[-2]} {near}", f"r1 {after}", f"r2 {after} {right[1]}", f"lr {near} {after}"]
    return out + [f"cue {w}" for w in dict.fromkeys(left[-CUES:]) if w != "^"]


def candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first word, last word, start, stop) of what may be an identifier.

    These are words with a digit or an @, runs of words that are numbers, and two words with an (at) between them; without marks at their edges.
    """
    numbers = 0
    for i, (a, b) in enumerate(words):
        word = text[a:b]
        if word in _AT and 0 < i < len(words) - 1:
            yield i - 1, i + 1, words[i - 1][0], words[i + 1][1]
        if not _MARK.search(word):
            numbers = 0
            continue
        yield i, i, a, b
        bare = word.rstrip(_EDGES)
        numbers = numbers + 1 if _NUMERIC.fullmatch(bare) else 0
        follows = i + 1 < len(words) and bare == word and _NUMERIC.fullmatch(text[slice(*words[i + 1])].rstrip(_EDGES))
        if numbers > 1 and not follows:
            yield i - numbers + 1, i, words[i - numbers + 1][0], b
        if bare != word:
            numbers = 0


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int, list[str]]]:
    """(start, kind or -1, stop, instance, kinds it could be, patterns) of the base spans and of candidates beside them."""
    if not spans and not _MARK.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    out, covered = [], []
    for a, k, b in spans:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        out.append((a, k, b, _named(text[a:b]), 0, patterns_of(text, words, first, last, a, b)))
        covered += range(first, last + 1)
    taken = set(covered)
    for first, last, a, b in candidates(text, words):
        if taken.isdisjoint(range(first, last + 1)):
            word = text[a:b]
            a, b = a + len(word) - len(word.lstrip(_EDGES)), b - len(word) + len(word.rstrip(_EDGES))
            if a < b:
                out.append((a, -1, b, _named(text[a:b]), could_be(text[a:b]), patterns_of(text, words, first, last, a, b)))
    return out


def _named(instance: str) -> str:
    """An instance in lower case; a long one by a digest."""
    return instance.lower() if len(instance) <= 64 else "#" + hashlib.md5(instance.lower().encode()).hexdigest()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
_SEEN = pa.list_(pa.struct([
    ("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("instance", pa.string()), ("could", pa.int32()), ("patterns", pa.list_(pa.string()))]))
_SPAN_TYPE = "array<struct<start: long, kind: int, stop: long>>"
_SEEN_TYPE = "array<struct<start: long, kind: int, stop: long, instance: string, could: int, patterns: array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, spans, seen): base spans and occurrences of each row; key is a digest of id and text."""
    small_batches(docs.sparkSession)
    key = row_key(F.col(id_col), F.col(text_col))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    kind = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seen, names = [], [], ("start", "kind", "stop", "instance", "could", "patterns")
            for text in batch.column(1):
                own = base_spans(text.as_py() or "")
                spans.append([dict(zip(names, x, strict=False)) for x in own])
                seen.append([dict(zip(names, x, strict=True)) for x in occurrences(text.as_py() or "", own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0).cast(kind), pa.array(spans, _SPANS), pa.array(seen, _SEEN)], ["key", "doc_id", "spans", "seen"])

    return docs.mapInArrow(run, f"key string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {_SPAN_TYPE}, seen {_SEEN_TYPE}")


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with the same id and text have the same key, and the same spans."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def confident_patterns(graph: DataFrame, turns: int = TURNS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, score) of the patterns that stay confident.

    graph: (pattern, instance, kind, could) with kind -1 for an instance of no known shape, which could be of the kinds of bits in `could`.
    Each instance of a pattern counts once, so that a text copied a thousand times weighs once.
    """
    kinds = range(len(KINDS))
    graph = materialize(graph.groupBy("pattern", "instance", "kind").agg(F.max("could").alias("could")), "graph")
    instances = materialize(graph.groupBy("instance", "kind").agg(F.max("could").alias("could")), "instances")
    # only patterns with enough seeds can pass; the rest of the graph need not be scored
    rich = graph.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    graph = materialize(spread_join(graph, rich.select("pattern").distinct(), "pattern"), "graph")
    known = [(F.col("kind") == k).cast("double").alias(f"s{k}") for k in kinds]

    def shares(rows: DataFrame, *by: str) -> DataFrame:
        """Of each kind k, how much is known (pos_k) and of how much (all_k)."""
        loose = [F.when((F.col("kind") < 0) & (F.col("could").bitwiseAND(1 << k) != 0), 1 - F.col(f"s{k}")).otherwise(0.0) for k in kinds]
        sums = [F.sum(f"s{k}").alias(f"pos{k}") for k in kinds]
        return rows.groupBy(*by).agg(*sums, *((F.count("*") - (1 - UNKNOWN) * F.sum(loose[k])).alias(f"all{k}") for k in kinds))

    found = None
    for turn in range(turns):
        scored, edges = instances.select("*", *known), graph.select("*", *known)
        if found is not None:
            own = [F.coalesce(F.col(f"f{k}"), F.col(f"s{k}")).alias(f"s{k}") for k in kinds]
            scored = scored.join(found, ["instance", "kind"], "left").select("instance", "kind", "could", *own)
            edges = spread_join(edges, found, ["instance", "kind"], "left").select("pattern", "instance", "kind", "could", *own)
        chance = shares(scored).first()
        rows = []
        for k in kinds:
            share, at = F.col(f"pos{k}") / F.col(f"all{k}"), (chance[f"pos{k}"] or 0.0) / (chance[f"all{k}"] or 1.0)
            good = (F.col(f"pos{k}") >= support) & (share >= confidence)
            if at < confidence:  # else whatever looks like an identifier is likely of this kind
                good = good & (share - at >= BEYOND * F.sqrt(F.lit(at * (1 - at)) / F.col(f"all{k}")))
            rows.append(F.when(good, F.struct(F.lit(k).alias("kind"), share.alias("score"))))
        patterns = shares(edges, "pattern").select("pattern", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("k"))
        patterns = materialize(patterns.select("pattern", "k.kind", "k.score"), "patterns")
        if turn < turns - 1:
            open_ = spread_join(graph.where("kind < 0"), patterns.select("pattern", F.col("kind").alias("as_kind"), "score"), "pattern")
            odds = [F.sum(F.when((F.col("as_kind") == k) & could("could", "as_kind"), F.log(F.greatest(1 - F.col("score"), F.lit(1e-6))))) for k in kinds]
            found = materialize(open_.groupBy("instance", "kind").agg(*((1 - F.exp(F.coalesce(x, F.lit(0.0)))).alias(f"f{k}") for k, x in enumerate(odds))), "found")
    return patterns


def could(bits: str, kind: str) -> Column:
    """The bit of a kind is set."""
    return F.expr(f"({bits} >> {kind}) & 1 = 1")


def found_by_context(scanned: DataFrame) -> DataFrame:
    """(key, more) of the rows of a written scan in which confident patterns point out spans, an array of (start, kind, stop)."""
    seen = scanned.select("key", F.explode("seen").alias("s")).select(
        "key", "s.start", "s.kind", "s.stop", "s.instance", "s.could", F.explode("s.patterns").alias("pattern"))
    patterns = confident_patterns(seen).select("pattern", F.col("kind").alias("as_kind"))
    return (
        spread_join(seen.where("kind < 0 and could <> 0"), patterns, "pattern").where(could("could", "as_kind"))
        .groupBy("key").agg(F.collect_set(F.struct("start", F.col("as_kind").alias("kind"), "stop")).alias("more"))
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, base, spans) for each row of docs: arrays of (start, kind, stop), sorted; spans holds base and more."""
    scanned = materialize(scan(docs, id_col, text_col), "scanned")
    none = F.array().cast(_SPAN_TYPE)
    return scanned.select("key", "doc_id", F.col("spans").alias("base")).join(found_by_context(scanned), "key", "left").select(
        "key", "doc_id", "base", F.sort_array(F.array_union("base", F.coalesce("more", none))).alias("spans"))


def spelt(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    """How many spans of a column are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def redacted(text: str, more: list[dict] | None = None) -> str:
    """The text with its base spans and `more` replaced by their kinds in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for start, kind, stop in sorted({*base_spans(text), *((m["start"], m["kind"], m["stop"]) for m in more or ())}):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, stop)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become one.

    Spans of the base are found again where they are replaced, so that texts are shuffled only if context finds spans in more than FEW rows.
    """
    more = materialize(found_by_context(materialize(scan(docs, id_col, text_col), "scanned")), "more")
    few = more.limit(FEW + 1).count() <= FEW and not more.where(F.size("more") > FEW_SPANS).limit(1).count()
    rows = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(more) if few else more, "key", "left").select("row", "text", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not t.is_valid else redacted(t.as_py(), m.as_py()) for t, m in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    rows = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return rows.select(*(F.col("text").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
