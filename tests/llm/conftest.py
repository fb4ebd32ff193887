import pytest

NAMES = "doc_id long, text string, score string, n_words int, key string, label int, signature string, held_out string"
LONG = "lorem ipsum dolor sit amet consectetur " * 6000
ROWS = [
    (1, "The mit license and the Apache, License. Idiot clown words here for everyone"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (None, "A text that has no id at all but some words"),
    (5, LONG),
    (6, "same words in the same order stand here twice for all to see"),
    (7, "same words in the same order stand here twice for all to see"),
    (6, "same words in the same order stand here twice for all to see"),
    (8, "x" * 3000),
    (9, "é ﬁ １ ▁▁ \x00 <|endoftext|> 字字 　 a\x1cb"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 1, "k", 0, "g", "h") for i, t in ROWS], NAMES).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
