import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text) pairs, with an extra column of an awkward name."""

    def make(rows, extra=None):
        schema = DOCS if extra is None else f"{DOCS}, {extra} string"
        full = [
            (i, t, "en", "s", None if t is None else len(t), *([] if extra is None else ["x"]))
            for i, t in rows
        ]
        return spark.createDataFrame(full, schema)

    return make
