import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, score double, label int, held boolean, rep long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    base = prose(1, 200)
    near = base.replace(" ", "  ", 3) + " tail"
    texts = [
        (1, base), (2, near), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "ONE\ttwo"), (9, prose(2, 30_000)), (10, prose(2, 30_000) + " more"),
        (11, prose(3, 60)), (11, prose(3, 60)), (None, prose(4, 50)), (12, "ünï cödé ☃ 字 " * 30), (13, prose(5, 5)), (14, "x" * 5000),
    ]
    return [(i, t, None, "s", None, True, 7, 0.5, 1, False, 3) for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
