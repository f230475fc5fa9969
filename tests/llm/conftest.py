import pytest

DOC = "doc_id long, text string, lang string, score double, component string, n int, rank int"


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names clash with what operators use."""
    return lambda rows: spark.createDataFrame([(d, t, "en", 0.5, "x", 1, 2) for d, t in rows], DOC)
