import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def clashing():
    """Columns with the names that operators use inside."""
    def add(df):
        from pyspark.sql import functions as F

        names = ["k", "h", "t", "row", "n", "c", "digest", "size", "u", "w", "q", "p", "copy", "word", "base", "node", "_k", "_h", "_d"]
        return df.select("*", *[F.lit("x").alias(n) for n in names])
    return add
