import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, TEXT)

    return make


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (4, long), (5, " \n \n"), (6, "password = abcdefghijkl1"), (7, None, None)]
    return docs(rows).withColumn("spans", F.lit("x")).withColumn("row", F.lit(1)).withColumn("bucket", F.lit(None).cast("string")).withColumn("class_id", F.lit(3)).withColumn("stats", F.lit(1)).withColumn("group", F.lit("g"))
