"""Reads of the corpus tables. Every read selects only the columns it needs, so
the parquet scan's ReadSchema is pruned and filters reach PushedFilters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


# Setting: into how many partitions corpus texts are dealt after the read. Unset (the default) they stay
# as the scan splits them, with no shuffle. A user sets it for a table that is stored as one row group.
PARTITIONS = "spark.stereoscope.corpus.partitions"


def _dealt(df: DataFrame, *key: str) -> DataFrame:
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), *key) if n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text")
