import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, _rid string, label string, rows string, key string, position string"


def words(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, names that operators use."""
    draw = random.Random(5)
    long = words(draw, 4000)
    data = [
        (1, None, None, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, "x", "x", "x", "x", "x"),
        (2, "", "en", "a", 0, "x", "x", "x", "x", "x"),
        (None, "no id here", "en", "a", 10, "x", "x", "x", "x", "x"),
        (3, " \t\n ", "en", "b", 4, "x", "x", "x", "x", "x"),
        (4, long, "en", "b", len(long), "x", "x", "x", "x", "x"),
        (4, long, "en", "b", len(long), "x", "x", "x", "x", "x"),
        (5, long + " more", "en", "b", None, "x", "x", "x", "x", "x"),
        (6, "😀 é ü 日本語 <|endoftext|>  x", "fr", "c", 28, "x", "x", "x", "x", "x"),
    ]
    data += [(10 + i, words(draw, 30 + i), "en", "abc"[i % 3], None, None, None, None, None, None) for i in range(40)]
    return spark.createDataFrame(data, KIND)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(10 + i, i % 2, i % 3 // 2) for i in range(40)] + [(None, 1, 1), (10, 0, 0), (11, None, 5)], "doc_id long, quality int, toxic int")
