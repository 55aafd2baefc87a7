import pytest

#: Null in every column, empty, blank, a repeated row, a null id, columns whose names clash with the operators' own.
AWKWARD = [
    (1, "Some words that are here for the test of it all", "en", "s", "x", 5),
    (1, "Some words that are here for the test of it all", "en", "s", "x", 5),
    (2, None, None, None, None, None),
    (None, "a text without an id", "en", None, "y", 1),
    (3, "", "de", "s", None, 0),
    (4, " \t\n ", "fr", "t", "z", 3),
    (5, "é" * 500 + " ß " + "日本語", "fr", "t", "z", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, id string, n long"


@pytest.fixture
def awkward(spark):
    """A table of awkward rows with a column `id` and `n`, which operators name their own columns."""
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], "doc_id long, text string")
