import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "ab cd efg hi jkl mno pq rstu vw xyz ond ter blu kin Zaf Éte ün ñu".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def changed(text, places):
    words = text.split(" ")
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, a very long text, ties, repeated rows, null ids and sources."""
    base = prose(1, 120)
    return [
        (1, base, "en", "a", 5), (2, changed(base, [3]), "en", "a", None), (3, changed(base, [3, 40, 80]), None, "b", 1), (4, None, "en", "a", None),
        (5, "", "en", None, 0), (6, " \n\t ", "en", None, 4), (7, prose(2, 60), "en", "a", 1), (7, prose(2, 60), "en", "a", 1), (8, "one two", "en", "", 7),
        (9, "One TWO", "en", "b", 7), (10, prose(3, 90_000), "de", "c", 9), (None, prose(4, 30), "en", "c", 2), (11, "Ünï " * 300, "fr", "b", 3),
        (12, "x" * 70_000, "en", "d", 3), (13, " " * 9_000 + "end", "en", "d", 3),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside."""
    extra = ["node", "keys", "size", "score", "spans", "label", "row", "x", "_key", "ids", "shard"]
    return spark.createDataFrame(odd_rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in extra])


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")
