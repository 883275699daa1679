import random

import pytest

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) + str(rng.randint(0, 40)) for _ in range(n))


LONG = prose(99, 30_000) + "é漢" * 2_000


@pytest.fixture
def docs_of(spark):
    """A documents table with columns whose names operators use themselves."""

    def build(rows):
        schema = "doc_id bigint, text string, lang string, n bigint, row string, node string, hash int, runs string, items string, tie int, `a.b` string"
        return spark.createDataFrame([(i, t, "en", 7, "r", None, 1, "x", None, 2, "c") for i, t in rows], schema)

    return build


@pytest.fixture
def odd(docs_of):
    """Nulls, empty and blank texts, a long text, repeated rows and equal ids."""
    return docs_of([
        (1, prose(1, 80)), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (1, prose(1, 80)), (6, "one"), (7, "One"),
        (8, prose(1, 80)), (None, prose(2, 50)), (9, "İ ﬁ \u0000 \U0001f600 A\u00a0b"), (6, prose(3, 40)),
    ])
