"""A corpus pipeline over ``documents``: each stage calls one operator of ``stereoscope.llm`` on all that
the stage before kept, is written as Parquet to the shared folder, and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stereoscope.llm import bpe, exact_dedup, mixing, queries, simhash, toxicity
from stereoscope.llm.common import read, staged


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by SimHash fingerprints stays."""
    return simhash.one_of_each(docs, shingle=3, distance=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated so that sources meet their target weights."""
    return mixing.mixed(docs, share=1.5, weights=(3, 1, 2))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: id, number of tokens, digests of the ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return queries.digests(bpe.encoded(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded_out="decoded", keep_text=False))


STAGES = [("toxicity", not_toxic), ("exact_dedup", exact_duplicates), ("simhash", near_duplicates), ("mixing", mix), ("bpe", tokens)]
ORACLE_SQL = None  # fingerprints (XXH64) and token ids have no SQL form; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
