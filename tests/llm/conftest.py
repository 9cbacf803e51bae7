import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; documents may have columns of the same names.
CLASHING = ("h", "hs", "t", "marks", "copy", "node", "key", "fp", "_id", "_gone", "_marks", "n", "words", "block", "cluster", "path_", "f0")


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randint(0, vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, ties, repeated rows, copies and passages."""
    rng = random.Random(11)
    passage = words(rng, 70, 10**6)
    rows = [(k, words(rng, rng.randint(1, 120)) + "\n" + (passage + "\n" if k % 4 == 0 else "") + words(rng, 30), ("en", "de")[k % 2], "s", 1) for k in range(30)]
    rows += [(100, None, "en", "s", 0), (101, "", None, None, None), (102, rows[0][1], "en", "s", 2), (103, rows[0][1], "en", "s", 2), (104, "a " * 9000, "de", "s", 3), (105, "é日本 " * 40, "de", None, 3), (106, "---- 12 %%", "en", "s", 3)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(7))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def loose(spark, odd_rows):
    """The same with a null id and a row that stands twice."""
    return spark.createDataFrame([*odd_rows, (None, odd_rows[4][1], "en", "s", 1), odd_rows[5]], SCHEMA).cache()
