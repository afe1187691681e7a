import pytest

from sparkrisk.llm.common import let_workers_import

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fingerprint int, kept string, t int"


@pytest.fixture(autouse=True)
def _workers(spark):
    let_workers_import(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, columns named like results."""
    long = "alpha beta gamma delta epsilon " * 4000
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, "x", 1, "y", 1),
        (1, "one two three four five six seven", "en", "a", 33, "x", 1, "y", 1),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 1, "y", 1),
        (4, " \n\t ", "en", "a", 4, "x", 1, "y", 1),
        (None, "no id here", "de", "b", 10, "x", 1, "y", 1),
        (5, long, "en", "a", len(long), "x", 1, "y", 1),
        (6, "\U0001f600 über 漢字 \u0000 x", "de", "b", 9, "x", 1, "y", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
