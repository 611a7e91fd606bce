import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, id string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) pairs, with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", None) for i, t in rows], DOCS)

    return make
