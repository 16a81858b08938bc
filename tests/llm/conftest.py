import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture
def docs(spark):
    """Make documents from texts, or from (id, text, lang, source)."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "en", "s0") for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS).repartition(3)

    return make


def words(rng, n, size=400):
    """Invented text of n words."""
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))
