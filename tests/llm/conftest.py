import pytest


@pytest.fixture()
def table(spark):
    """Documents from texts, or from rows and a schema."""
    def make(texts, schema=None):
        if schema:
            return spark.createDataFrame(texts, schema)
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return make
