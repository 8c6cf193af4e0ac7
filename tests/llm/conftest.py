import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "src", len(t or ""), "x", 7, "y", None, 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, block string, score int, bucket string, part string, key int")

    return make


EDGES = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (5, "word"), (5, "word"), (None, "word"), (6, "12 34 ."), (7, "long " * 40_000), (8, "日本語 é \U0001f600")]


@pytest.fixture
def edges():
    return EDGES
