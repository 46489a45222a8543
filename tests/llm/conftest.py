import pytest


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text, source) with a column of a clashing name beside them."""

    def make(rows, schema="doc_id bigint, text string, source string, kept string, key string, length string"):
        width = schema.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make
