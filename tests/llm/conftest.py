import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows with a column whose name clashes with internals."""

    def make(rows, **extra):
        full = [(i, t, "en", f"src{(i or 0) % 3}", 0 if t is None else len(t), True, 1.5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double")

    return make


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a"), (None, "a b c d e f"), (5, "x " * 3000), (5, "x " * 3000), (6, "é😀 日本 " * 5)]


@pytest.fixture
def odd():
    return list(ODD)
