import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = write(rng, 40_000)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\r ", None, "a", 7), (4, "One, two", "en", None, 8), (None, "an orphan text of seven words here", "de", "b", 34),
        (5, long, "en", "b", len(long)), (6, "x" * 70_000, None, None, 70_000), (7, "Žluťoučký kůň úpěl ďábelské ódy. \U0001f600 £ß", "cs", "b", 40), (None, None, None, None, None),
        (8, "the same text of more than five words", "en", "a", 37), (9, "the same text of more than five words", "en", "a", 37), (9, "the same text of more than five words", "en", "a", 37),
    ]
    return rows + [(100 + i, write(rng, rng.randint(5, 80)), rng.choice(["en", "de"]), rng.choice("abc"), None) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with further columns of names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["rep", "bands", "g", "n", "part", "ids", "host", "kept", "score", "words", "block", "c", "rate", "copy", "shard", "grp", "fingerprint", "n_words", "label", "id", "size", "bytes", "draw", "target", "ws"]
    return odd.withColumns({x: F.lit("z") for x in names})
