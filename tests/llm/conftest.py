import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        T.StructField("node", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("row", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text, source) as a table with clashing extra columns."""

    def make(*rows):
        return spark.createDataFrame([(i, t, s, "n", "k", "d", "r") for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
