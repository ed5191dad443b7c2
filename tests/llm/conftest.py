import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, doc string, fp double, key string"
LONG = "lorem ipsum dolor " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36, 7, "d", 0.5, "k"),
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36, 7, "d", 0.5, "k"),
        (2, None, "en", None, None, None, None, None, None),
        (3, "", None, "b", 0, 1, "x", 1.0, "y"),
        (4, " \t\n\x0b ", "fr", "b", 5, 1, "x", 1.0, "y"),
        (5, LONG, "la", "c", len(LONG), 1, "x", 1.0, "y"),
        (None, "no id here \u00e9\u4e2d\U0001f600", "en", "a", 14, 1, "x", 1.0, "y"),
        (6, "ALPHA beta gamma delta epsilon zeta.", "en", "b", 36, 1, "x", 1.0, "y"),
        (7, "\u0130stanbul <|endoftext|> \x1c \u2581 <s> it's we'll 3 44\r\n\r\nend  ", "tr", "\u00e9", 30, 1, "x", 1.0, "y"),
        (8, "x" * 5000, "", "", 5000, 1, "x", 1.0, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.where("false")
