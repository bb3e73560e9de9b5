import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "12 !! 34", None, "s", 8), (5, long, "en", None, len(long)), (6, "the cat and the dog " * 3, "en", "s", 60), (6, "the cat and the dog " * 3, "en", "s", 60), (7, "the cat and the dog " * 3, "en", "s", 60), (None, "the end of it all was near", "en", "s", 5), (8, "él\u0000 niño \U0001d54f ▁x", "es", "s", 9)]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit(1) for c in ("id", "size", "score", "bucket", "rank", "weight", "kept", "topic", "n_tokens", "node", "comp")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
