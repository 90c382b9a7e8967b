"""The queries of the operators of this subpackage, one for each, over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dup, importance, lang_crf, near_dup, packing, pii, ppm, quality_rules, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The vocabulary file of the contracts, in the folder BLOBSMITH_TOKENIZERS names or else in the installed package."""
    import public_tokenizers

    folder = os.environ.get("BLOBSMITH_TOKENIZERS")
    return f"{folder}/word_bpe_49k.json" if folder else public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document with the verdict of the default policy."""
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    base = F.col("failure_bits").bitwiseAND(F.lit(quality_rules.POLICIES["base_v1"])) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept",
        "failure_bits")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document, learned from the documents whose fold is not 0."""
    fold = lang_crf.fold(F.col("doc_id"), 10)
    return ppm.score(table(spark, sf_dir, "documents"), fold != 0, fold == 0)


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), word_bpe()), word_bpe())
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importance weight of every document towards the labelled good ones, and the documents drawn.

    As many are drawn as the labels say are good.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = good.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    return importance.select(docs, good.where("quality = 1"), share)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), similarity=85)


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data of every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", name).alias(f"n_{name}") for name in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spelt(F.col("base")), 256).alias("base_sha256"), pii.spelt(F.col("spans")).alias("spans"))


def op9_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and component of every vector."""
    return embed_dup.link(table(spark, sf_dir, "embeddings"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents whose fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    fold = lang_crf.fold(F.col("doc_id"), 3)
    found = lang_crf.predict(docs, lang_crf.learn(docs.where(fold != 1)))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ppm": op2_ppm,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_bpe": op4_bpe,
    "op5_importance": op5_importance,
    "op6_minhash": op6_minhash,
    "op7_link_graph": op7_link_graph,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_pivot_permutation": op9_pivot_permutation,
    "op10_language_crf": op10_language_crf,
}

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(characters: str) -> str:
    """SQL of how many characters of a class a text has."""
    return f"length(regexp_replace(text, '[^{characters}]', '', 'g'))"


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality_rules.RULES.values()))

#: The ledger word by word: a window is its eight words, and the words covered by repeated windows are counted from start to start.
_RULES_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
 v AS (SELECT k, i, array_to_string(words[i : i + 7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
 r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM v) WHERE n > 1),
 c AS (SELECT k, sum(least(8, nxt - i)) AS n FROM (SELECT k, i, lead(i, 1, i + 8) OVER (PARTITION BY k ORDER BY i) AS nxt FROM r) GROUP BY k),
 m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST({_count("#*$%&|<>")} AS BIGINT) AS n_symbols,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(list_distinct(words)) AS n_distinct_words,
  {_count("A-Z")} AS n_upper, {_count("A-Za-z")} AS n_letters, {_count("0-9")} AS n_digits, {_count("!")} AS n_shouts FROM w LEFT JOIN c USING (k)),
 b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failure_bits FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & {quality_rules.POLICIES["base_v1"]} <> 0 AS base_failed,
 failure_bits & {quality_rules.POLICIES[quality_rules.DEFAULT_POLICY]} = 0 AS kept, failure_bits FROM b""".replace("\\\\", "\\")

#: All pairs that share a shingle, and what they reach.
_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
 r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
 SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

#: All pairs of vectors.
_VECTOR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {embed_dup.COSINE}),
 n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
 r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach)
 SELECT vec_id, coalesce(any_value(n.n), 0) AS n_links, min(reach) AS component_id, vec_id = min(reach) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id"""

#: Ranks as the sum of what arrives from the seeds after each number of steps.
_LINKS_SQL = f"""WITH RECURSIVE u AS (SELECT row_number() OVER () AS k, page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filters._UPPER}', '{url_filters._LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 rules(verdict, host, path) AS (VALUES {", ".join(str(tuple(r)) for r in url_filters.RULES)}),
 f AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict FROM u JOIN rules r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY k),
 h AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{url_filters._UPPER}', '{url_filters._LOWER}') AS dst FROM u),
 parts AS (SELECT DISTINCT string_split(host, '.') AS p FROM u),
 ups AS (SELECT DISTINCT array_to_string(p[i:], '.') AS a, array_to_string(p[i + 1 :], '.') AS b FROM parts, unnest(range(1, len(p) - 1)) AS t(i)),
 e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM h WHERE src <> '' AND src <> dst UNION ALL SELECT a, b FROM ups UNION ALL SELECT b, a FROM ups) GROUP BY 1, 2),
 both_ways AS (SELECT 0 AS kind, src AS host, dst AS nxt, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
 ways AS (SELECT kind, host, nxt, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM both_ways),
 seeds AS (SELECT CASE verdict WHEN 'allow' THEN 0 ELSE 1 END AS kind, host, count(*) AS n FROM u JOIN f USING (k) WHERE host <> '' GROUP BY 1, 2),
 moved AS (SELECT 0 AS turn, kind, host, CAST(n / sum(n) OVER (PARTITION BY kind) AS DOUBLE) AS score FROM seeds
  UNION ALL SELECT any_value(turn) + 1, kind, nxt, sum(score * share * {url_filters.DAMPING}) FROM moved JOIN ways USING (kind, host) WHERE turn < 60 GROUP BY kind, nxt),
 ranks AS (SELECT host, sum(score) FILTER (kind = 0) AS trust, sum(score) FILTER (kind = 1) AS distrust FROM moved GROUP BY host)
 SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > {url_filters.THRESHOLD} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
 FROM u LEFT JOIN f USING (k) LEFT JOIN ranks USING (host)"""

#: The models of the other operators have no SQL.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _RULES_SQL, "op6_minhash": _NEAR_SQL, "op7_link_graph": _LINKS_SQL, "op9_pivot_permutation": _VECTOR_SQL,
}
