import pytest


@pytest.fixture
def rows(spark):
    """Documents as a DataFrame, with columns that clash with what operators add."""

    def make(pairs, ids="long"):
        return spark.createDataFrame([(i, t, "s", 1, "x", "y") for i, t in pairs], f"doc_id {ids}, text string, source string, n_words int, kept string, block string")

    return make
