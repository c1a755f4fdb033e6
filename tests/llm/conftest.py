import pytest

EDGES = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "one"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"),
    (8, "é ñ ß 日本語 " * 40),
    (9, "x" * 70000),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi sigma " * 300),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (11, "the same row"),
    (11, "the same row"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeats, and columns with names that operators use too."""
    rows = [(i, t, "zz", 5, True, "body") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept boolean, chunk string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_words int, kept boolean, chunk string")
