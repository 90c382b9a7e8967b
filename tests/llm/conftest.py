"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, kept boolean, n_words string, sequence_id int, score string, key long"


def rows(texts, first=0):
    return [(first + i, t, "en", None, "x", 1, None, 5) for i, t in enumerate(texts)]


@pytest.fixture
def odd_docs(spark):
    words = " ".join(f"word{i}" for i in range(60))
    texts = ["", None, "   \n\t ", "one", words, words, words.upper(), words.replace("word3 ", "other "), "x" * 50_000,
             " ".join(f"w{i % 50}" for i in range(30_000)), "naïve café <|endoftext|> ΑΣ\x1c 日本 語 123"]
    made = rows(texts) + [(None, words, "en", None, "x", 1, None, 5), (4, words, "en", None, "x", 1, None, 5), (4, "another text of the same id", None, True, None, None, None, None)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
