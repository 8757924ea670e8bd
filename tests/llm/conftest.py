import pytest


@pytest.fixture
def frame(spark):
    """Documents of (doc_id, text[, lang[, source]]) with two extra columns of clashing names."""

    def make(*rows):
        full = [(*r, *([None] * (4 - len(r))), 7, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score int, size string")

    return make
