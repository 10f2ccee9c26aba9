import pytest
from pyspark.sql import types as S

DOCS = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("lang", S.StringType()), S.StructField("source", S.StringType()), S.StructField("n_chars", S.LongType()), S.StructField("k", S.StringType()), S.StructField("block", S.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "one two"), (None, "one two three four five six"), (6, "a " * 30000), (7, "Ä́ß\x00\x01  x")]
