import pytest

from tidemark.llm import common

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) of the small table."""
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


MESSY = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None), (4, ""), (5, "   \n\t\n"), (6, "word"), (None, "a row without a key"), (None, None),
    (7, "Ünïcode ß ﷺ 漢字 \U0001f600 text"), (8, LONG), (9, LONG), (10, "x" * 30000), (11, "\x00\x01 control"),
    (12, "one line\none line\n\ntwo lines"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, repeated rows and keys, and columns whose names the operators use inside."""
    common.prepare(spark)
    rows = [(k, t, "a", "b", 1, 2, 3.0) for k, t in MESSY]
    return spark.createDataFrame(
        rows, "doc_id long, text string, row string, body string, copy int, component_id int, fingerprint double")


@pytest.fixture(scope="session")
def empty(spark):
    return common.prepare(spark).createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
