import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Make a documents table of (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("id", T.StringType()), ("key", T.IntegerType()), ("label", T.StringType()), ("score", T.StringType()), ("row", T.StringType()), ("size", T.StringType()))])

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "y", "z", "r", "s") for i, t in rows], schema)

    return make


@pytest.fixture
def awkward(docs):
    """Nulls, blanks, ties, repeated rows and a very long text."""
    return docs([(1, None), (2, ""), (3, " \t\n"), (4, "same text here"), (5, "same  text here"), (6, "same text here"), (6, "same text here"), (None, "same text here"), (7, "w " * 60_000), (8, "x" * 100_000), (9, "1" * 50_000)])


@pytest.fixture
def nothing(docs):
    return docs([])
