import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and copies near and exact."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    long = [word() for _ in range(400)]
    near = [*long[:200], "changed", *long[201:]]
    passage = [word() for _ in range(70)]
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one two", "en", "a", 7),
        (5, "One  two", "en", None, 8),
        (6, " ".join(long), "en", "a", 9),
        (7, " ".join(near), "fr", "a", 9),
        (8, " ".join(long), "fr", "b", 9),
        (None, " ".join(long), "fr", "b", 9),
        (9, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)]), "de", "b", 9),
        (10, "\n".join([word() for _ in range(10)] + passage + [word() for _ in range(40)]), "de", "b", 9),
        (11, "x" * 200_000, "de", "b", 9),
        (12, " ".join(["same"] * 3000), "de", "b", 9),
        (13, "déjà vu ça été <|endoftext|> ÉTÉ 漢字 😀 " * 30, "fr", "b", 9),
        (14, "déjà vu ça été <|endoftext|> ÉTÉ 漢字 😀 " * 30, "fr", "b", 9),
        (14, "déjà vu ça été <|endoftext|> ÉTÉ 漢字 😀 " * 30, "fr", "b", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    # Extra columns with names that operators use for their own.
    names = ["component_id", "kept", "sketch", "rep", "spans", "text_id", "node", "rank", "score", "chunk", "label"]
    return spark.createDataFrame(odd_rows, DOCS).withColumns({n: F.lit("own") for n in names}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(4, 14)] + [(None, 1, 1), (6, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
