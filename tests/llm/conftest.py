import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# columns whose names the operators use themselves
CLASHES = ["_doc", "_file", "_row", "_text", "ids", "copies", "size", "root", "fp", "score", "kept", "_k_n"]


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest tables, as (doc_id, text) too."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


ODD = [
    (1, "The cat sat on the mat today", "en", "a", 1), (2, "The cat sat  on the\tmat today ", "en", "a", 1), (3, None, "en", "b", None),
    (4, "", None, None, 0), (5, " \t\n", "en", "", 3), (6, "x" * 30000 + " " + "word " * 20000, "en", "a", 1),
    (7, "The cat sat on the mat today", "en", None, 1), (7, "The cat sat on the mat today", "en", None, 1), (None, "The cat sat on the mat today", "en", "a", 1),
    (None, "no id here", "de", "b", 1), (8, "déjà vu  日本語   𝒳 don't <|endoftext|> 100%", "fr", "b", 1), (9, "one", "en", "c", 1), (10, "one two", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids."""
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    out = odd
    from pyspark.sql import functions as F
    for c in CLASHES:
        out = out.withColumn(c, F.lit("mine"))
    return out


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
