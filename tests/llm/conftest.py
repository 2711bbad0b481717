import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, _words int"


def sentence(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; columns whose names clash with internal ones."""
    rnd = random.Random(3)
    base = sentence(rnd, 120)
    long = sentence(rnd, 20_000, 3000)
    rows = [
        (1, base, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 1), (5, base, "en", "a", 5), (5, base, "en", "a", 5), (5, "other text", "en", "a", 5),
        (None, base + " tail", None, "b", 3), (None, None, None, None, None), (6, long, "fr", "b", 9), (7, "éà ü　x \x1c y \U0001f600 </s> <|endoftext|> it's don't", "fr", "c", 9),
        (8, sentence(rnd, 60) + " " + base[: len(base) // 2] + " " + sentence(rnd, 5), "en", "a", 4), (9, "word", "en", "a", 4), (10, base.upper(), "en", "a", 4), (11, "a b c d e f g h\na b c d e f g h\na b c d e f g h\nx", "en", "a", 4),
    ]
    return [(*r, 0.5, "x", 1) for r in rows]


@pytest.fixture
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
