import random

import pytest

ODD = [
    (1, None, None, None), (2, "", "s", None), (3, " \n\t ", None, "en"), (4, "one", "s", "en"), (5, "One", "s", "en"), (5, "One", "s", "en"),
    (6, "a b c d e f g h i j k l", "t", "de"), (None, "a b c d e f g h i j k l", "t", "de"), (None, None, None, None),
    (7, "$$$ *** 123 ...", "t", None), (8, "日本語 のテキスト", "", "ja"), (9, " non breaking \x1fcontrol", "u", "en"), (10, "word " * 3000, "u", "en"), (11, "word " * 3000 + "end", "u", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"
#: names that operators use inside
CLASHING = ["row", "size", "hit", "found", "doc", "key", "runs", "class", "unit", "role", "c0", "n", "words", "copies", "rate", "target", "label", "id", "k", "n_words", "n_removed", "last", "src", "bucket", "blob", "word", "score", "matches", "places", "__x", "__gone", "t", "row_", "key", "first_id", "hot", "doc_", "x", "place"]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for i, c in enumerate(CLASHING):
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(i))
    return df


@pytest.fixture
def none(odd):
    return odd.where("false")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
