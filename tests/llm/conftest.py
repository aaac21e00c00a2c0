import pytest

from spanflow.llm.common import tune

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, one very long text, line ends of all kinds.
ODD = [(1, "a b c d e"), (2, None), (3, ""), (4, " \t\n "), (5, "a  b\tc d e"), (6, "one"), (7, "x y " * 20000), (8, "é ß 日本 ½ don't"), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (10, "A B C D E")]


@pytest.fixture(scope="session")
def docs(spark):
    tune(spark)
    rows = [(i, t, "en" if i != 6 else None, "s", len(t or "")) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    tune(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest test table, with columns that clash with results' names."""
    import os

    from pyspark.sql import functions as F

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    return tune(spark).read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit("x") for c in ("score", "rate", "keep_id", "row", "id", "key")})
