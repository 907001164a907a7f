import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    texts = [None, "", " ", "one two", "Same text here for all of us, friends.", "Same text here for all of us, friends.", long, long + " more", "é" * 500, "\n\n", "x@y.zz +1 (603) 555-8791"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id at all in this row", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
