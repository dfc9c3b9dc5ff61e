import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bin string, key long, f0 long"


def word(x):
    """The x-th made-up word."""
    r = random.Random(x)
    return "".join(r.choice("abcdefghij") for _ in range(2 + x % 5)) + str(x % 3)


WORDS = [word(x) for x in range(5000)]


def prose(r, n, vocabulary=400):
    return " ".join(WORDS[r.randrange(vocabulary)] for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty and very long texts, repeated rows, ties, copies; extra columns clash with names the operators use."""
    r = random.Random(4)
    base = [prose(r, r.randint(1, 120)) for _ in range(60)]
    long_text = prose(r, 30000)
    texts = [*base, *base[:15], base[0] + " tail", None, "", "   \n\t ", long_text, long_text, "ß ñ é x y", "x" * 5000]
    rows = [(i, t, "en", "s", 0, -1, "b", 5, 9) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base[5], None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
