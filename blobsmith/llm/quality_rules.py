"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. A policy is
a named, versioned mask over those bits, so that changing a policy, comparing two, or finding what a single rule costs
(an ablation) are bitwise aggregations over the ledger and never read a text again.

Defined results: a null or empty text has no words and fails `few_words`; rows with a null or repeated id are judged row
by row; other columns of the input are ignored, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper",
    "n_letters", "n_digits", "n_shouts",
)

#: Rule name -> SQL condition of failing, over the measurements. The order gives the bits; append only.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "upper_case": "100 * n_upper > 40 * n_letters",
    "shouts": "100 * n_shouts > 20 * n_words",
    "digits": "100 * n_digits > 40 * word_chars",
    "few_distinct_words": "n_words >= 100 and 100 * n_distinct_words < 2 * n_words",
    "hardly_any_words": "n_words < 3",
}


def mask(*names: str) -> int:
    """The bits of the named rules."""
    return sum(1 << list(RULES).index(n) for n in set(names))


#: Policy name -> mask. A version is never changed; a new one is added.
POLICIES = {
    "base_v1": mask("few_words", "repeated_windows"),
    "web_v1": mask("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
    "web_v2": mask(*(n for n in RULES if n != "hardly_any_words")),
    # short texts may be clean
    "clean_v1": mask(*(n for n in RULES if n != "few_words")),
}
DEFAULT_POLICY = "web_v2"

_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a WINDOW-word window found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    rolled = one[:n] * _MIX[0]
    for i in range(1, WINDOW):
        rolled += one[i : n + i] * _MIX[i]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]
    count = Counter(windows)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at, windows, strict=True):
        if count[window] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    codes = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((codes - np.uint8(65)) < 26))
    lower = int(np.count_nonzero((codes - np.uint8(97)) < 26))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated_words(words), len(set(words)), upper, upper + lower,
        int(np.count_nonzero((codes - np.uint8(48)) < 10)), text.count("!"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure_text(x) for x in batch.column(1).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], [batch.schema.names[0], *MEASURES])


def _measures(docs: DataFrame, first: Column, text: Column) -> DataFrame:
    """The measures of each text and its failure bits beside one column, which is passed through."""
    small_batches(docs.sparkSession)
    docs = docs.select(first, text.alias("text"))
    schema = T.StructType([docs.schema[0], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return docs.mapInArrow(_measured, schema).withColumn("failure_bits", failure_bits())


def failure_bits(rules: dict[str, str] = RULES) -> Column:
    """One long with a bit for each failing rule."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the MEASURES (long) and failure_bits (long): a row for each row of docs."""
    return _measures(docs, F.col(id_col).alias("doc_id"), F.col(text_col))


def screen(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the policy keeps."""
    rows = apply_policy(_measures(docs, F.struct("*").alias("_row"), F.col(text_col)), policy)
    return rows.where("kept").select("_row.*")


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds kept: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of the policy: documents failing it, and documents that only it rejects (what dropping it regains).

    One pass with partial aggregation: documents are first counted by their masked bits, of which there are at most
    2 ** number of rules, and the rules are then read off those few rows.
    """
    chosen = POLICIES[policy]
    names = [(n, 1 << i) for i, n in enumerate(RULES) if chosen >> i & 1]
    bits = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in names))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        bits.withColumn("r", F.explode(each)).select("bits", "n", "r.rule", "r.bit").groupBy("rule")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
             F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
    )
