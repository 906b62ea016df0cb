import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of documents: (doc_id, text, lang, source)."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], "doc_id long, text string, lang string, source string, n_chars long")

    return make
