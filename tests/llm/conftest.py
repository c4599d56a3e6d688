import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gid long, `__row` string, rate double, winner long, detected string, label long"


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "x", 0.5, 9, "zz", 3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that clash."""
    long = words(30_000, 1)
    rows = [
        row(1, long), row(2, long), row(3, words(80, 2)), row(3, words(80, 2)), row(4, ""), row(5, ""), row(6, None), row(7, None, None, None), row(None, words(80, 3)), row(None, words(80, 3)),
        row(None, None), row(8, "a"), row(9, "  \n\t "), row(10, "x" * 20_000), row(11, "!!! ??? 🙂 ▁  "), row(12, words(80, 2) + " end"), row(13, words(60, 5), None, ""),
        (None,) * 11,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
