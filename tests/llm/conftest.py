import random

import pytest

WORDS = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


#: Nulls, empty, repeated rows and ids, ties, no ASCII, no words, a long text.
ODD = [(None, "some text of no id"), (None, None), (1, None), (2, ""), (3, "x"), (3, "x"), (3, "y other"), (4, "日本語 テキスト é 🎉"), (5, " \t\n "), (6, "zz" * 30_000), (7, prose(7, 4000)), (8, prose(8, 60)), (9, prose(8, 60)), (10, prose(10, 60))]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with columns that clash with names that operators use."""
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 4 else None, "extra", n) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, score int")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
