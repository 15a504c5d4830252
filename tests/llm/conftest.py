import pytest

SCHEMA = "doc_id bigint, text string, lang string, key string, row int, f int, shard int, n int, score int, rank int, label int, domain string, data string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns that operators use inside, from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "k", 1, 2, 3, 4, 5, 6, 7, "d", "x") for i, t in rows], SCHEMA)

    return make


WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edges():
    """Null ids and texts, empty and white texts, repeated rows, ties, a long text, text that is not ASCII."""
    long = prose(1, 20_000)
    return [
        (None, None), (None, "a b c"), (None, prose(5, 80)), (1, None), (2, ""), (3, " \n\t "), (4, prose(5, 80)), (5, prose(5, 80)), (5, prose(5, 80)),
        (6, prose(6, 90)), (6, prose(7, 90)), (7, long), (8, long + " end"), (9, "Ärger über Öl \x00 İ é"), (10, "x"), (-3, prose(6, 90)),
    ]
