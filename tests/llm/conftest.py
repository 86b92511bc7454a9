import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("node", "root", "_node", "_doc", "_copies", "_stays", "_starts", "_ends", "_lang", "_family", "_accepted", "marks", "shard", "sample", "size", "rank", "g", "label", "h")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in each column, empty, blank, repeated and very long texts."""
    rng = random.Random(5)
    long = sentence(rng, 60_000, 5000)
    body = sentence(rng, 120)
    return [
        (1, body, "en", "a", 10),
        (2, None, "en", "a", 0),
        (3, "", "en", "a", 0),
        (4, " \n\t ", None, None, None),
        (None, sentence(rng, 80), "fr", "b", 5),
        (None, None, None, None, None),
        (5, body, "en", None, 10),
        (5, body, "en", None, 10),
        (6, long, "de", "c", len(long)),
        (7, "!!! ??? ...", "en", "a", 11),
        (8, "one", "en", "a", 3),
        (9, sentence(rng, 200) + ". " + sentence(rng, 30), "es", "d", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The same rows with further columns whose names are used inside of operators."""
    return spark.createDataFrame([(*r, *(f"x{i}" for i in range(len(CLASHING)))) for r in odd_rows], DOCUMENTS + "".join(f", {c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
