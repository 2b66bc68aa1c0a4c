import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def documents(spark):
    """Documents from (id, text) pairs, with the table's other columns."""

    def make(pairs):
        return spark.createDataFrame([(i, t, None, "s", len(t) if t else None) for i, t in pairs], DOC)

    return make
