import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, size long, keep_id string, kept string, n string, copies string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma\nshared line", "en", "a", 5, "x", "y", "z", "c"),
        (2, "Alpha  beta\tgamma\nshared line ", "en", "a", None, None, None, None, None),
        (2, "Alpha  beta\tgamma\nshared line ", "en", "a", None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "de", "b", 1, "x", "y", "z", "c"),
        (5, " \n\t ", "de", None, 1, "x", "y", "z", "c"),
        (6, LONG, "en", "b", 1, "x", "y", "z", "c"),
        (7, LONG, "en", "c", 1, "x", "y", "z", "c"),
        (None, "no id here at all", "en", "a", 1, "x", "y", "z", "c"),
        (8, "É Ünïcode <|im_end|>   \x85 ¶ \x1e end", "fr", "c", 1, "x", "y", "z", "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rng():
    return random.Random(5)
