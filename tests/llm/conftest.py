"""Small documents with everything that may go wrong, and extra columns whose names clash with internal ones."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key_ string, t_ string, row_ int, spans string"


def make(spark, rows, schema=DOC):
    full = [(i, t, "en", "s", None if t is None else len(t), "k", "t", 1, "x") for i, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: make(spark, rows)


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew potent quaffs in a very deep vault beneath old stones " * 1


def prose(n, seed=0):
    """n distinct words of invented prose with stop words among them."""
    import random

    r = random.Random(f"p{seed}")
    bits = "ka lo mi ren tu va zo pe shi".split()
    return " ".join("the" if k % 7 == 3 else "".join(r.choice(bits) for _ in range(4)) for k in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def words():
    return prose
