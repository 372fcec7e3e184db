import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from ``(doc_id, text)`` pairs."""

    def make(rows, parts=3):
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    names = "_slot _shard row alt doc recipe keep_id group_size kept chunk cid hit copy start length ids offset bucket word pos h hash shard slot lines key n_hit n_words spans rejected score".split()
    return lambda df: df.withColumns({n: F.lit("x") for n in names})
