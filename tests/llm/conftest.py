import pytest

SF = "/root/testdata/sf0.001"

EXTRA = "lang string, source string, n_chars long, slot int, kind string, cls long, label int, score double, spans string, body string, rate double, bucket long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base), (2, base), (2, base), (2, "other words of the same id stand here now"), (3, None), (4, ""), (5, "  \n\t "), (6, "hi"),
            (7, "hi"), (None, base), (None, None), (8, "x" * 300_000), (9, "a b " * 40_000), (10, base + " mail me at a.b@c.de or +1 (555) 123-4567")]
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", 2, 3, 0.5, "s", "b", 1.0, 4) for i, t in rows], "doc_id long, text string, " + EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, " + EXTRA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
