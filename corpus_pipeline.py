"""From raw documents to packed sequences: the stages of a training-data pipeline over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsmith.llm import lang_crf, near_dup, packing, pii, quality_rules
from blobsmith.llm.common import materialize
from blobsmith.llm.queries import word_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose words agree on a language less than this is rejected. With four languages, chance gives 0.25.
LEAST_LANGUAGE_SCORE = 0.4
#: Of a hundred, by shingles of five words: documents so similar are near-duplicates.
NEAR_SIMILARITY = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled ones, fold 1 of 3 left out of learning."""
    model = lang_crf.learn(docs.where(lang_crf.fold(F.col("doc_id"), 3) != 1))
    return lang_crf.screen(docs, model, LEAST_LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, short ones kept."""
    return quality_rules.screen(docs, "clean_v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.deduplicate(docs, similarity=NEAR_SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return packing.pack(docs, word_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack),
]

#: SQL has no words for these models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
