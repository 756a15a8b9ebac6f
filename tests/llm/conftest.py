import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, s long, key string, kept int, t string, w string, words string, label string, target double"


def rows_of(rows):
    """(doc_id, text, lang, source) with columns whose names operators use inside."""
    return [(i, t, lang, src, len(t or ""), 7, 7, 7, "x", 7, "x", "x", "x", "x", 7.0) for i, t, lang, src in rows]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    r = random.Random(seed * 7 + 1)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text, lang, source) rows, with extra columns."""
    return lambda rows: spark.createDataFrame(rows_of(rows), SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    long_text = prose(1, 30_000)
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", None), (4, "the one and only", "en", "b"),
        (4, "the one and only", "en", "b"), (5, "the  one\nand only", None, "b"), (None, "the one and only", "en", "a"), (None, None, None, None),
        (6, long_text, "fr", "a"), (7, long_text, "fr", "a"), (8, long_text + " end", "fr", None), (9, "12 34 !!", "en", "c"), (10, "Été 😀 naïve ▁ x", "fr", "c"),
    ]
