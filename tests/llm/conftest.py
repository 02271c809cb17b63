import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, owner string, `a.b` int, start int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns whose names clash with those inside."""
    passage = " ".join(f"word{i}" for i in range(70)) + "."
    rows = [
        (1, passage, "en", "s", 1, "x", 1, 1),
        (2, "lead in " + passage + " tail", "en", None, None, None, None, None),
        (2, "lead in " + passage + " tail", "en", None, None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "s", 0, "", 0, 0),
        (None, passage, "en", "s", 1, "x", 1, 1),
        (5, "long " * 60_000 + "me.here@example.com end", None, "s", 5, "x", 1, 1),
        (6, "...!!! ???", "en", "s", 1, "x", 1, 1),
        (7, "One short line only.\nOne short line only.", "en", "s", 1, "x", 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
