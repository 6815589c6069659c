import pytest

CLASHES = "keep_id row_id fp doc bad_id kept_id kept_sha listed_id norm_sha256 pick component_id n digest unit".split()
AWKWARD = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, a repeated id, and columns that clash with the operators' own."""
    long = "alpha beta gamma delta " * 4000
    rows = [(1, "one two three four five six seven eight nine ten eleven", "en"), (2, "", "en"), (3, None, None), (4, "   \n\t", "de"), (5, "a", None), (6, long, "en"), (7, long + " end", "en"), (8, "a", "fr"), (8, "a", "fr"), (9, "a ", "fr"), (None, "text without an id", None), (None, None, None), (10, "same id one", "x"), (10, "same id two", "x"), (11, "mail x@y.org", "en")]
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], AWKWARD).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)
