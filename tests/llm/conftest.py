import pytest

CLASHING = "id string, bucket string, anchor string, owner string, shard string, lang string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents (doc_id, text) with extra columns whose names operators use inside."""

    def run(rows, extra=True):
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        wide = [(*r, "i", "b", "a", "o", "s", "en", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, " + CLASHING)

    return run
