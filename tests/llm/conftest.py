import pytest

LONG = "word another thing " * 20_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in each column, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s1", 7, 0.5, "x"), (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s1", 7, 0.5, "x"),
        (2, "", "en", "s1", None, None, None), (3, None, "de", None, None, None, None), (None, "der hund und die katze gehen nach hause.", "de", "s2", 1, 1.0, "y"), (5, LONG, None, "s2", 1, 1.0, "y"),
        (6, "!!! ... ###", "en", "s1", 1, 1.0, "y"), (7, "le chat et le chien vont à la maison \U0001f600", "fr", "s3", 1, 1.0, "y"), (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
