import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("kept", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows, with clashing extra columns."""

    def make(*rows, parts=3):
        full = [(*row, *(None,) * (3 - len(row)), "s", None if row[1] is None else len(row[1]), "k", None, "x", None) for row in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make
