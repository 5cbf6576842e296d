import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a documents table with all of its columns."""

    def make(rows, **extra):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        values = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(values, schema)

    return make
