"""The mining flow over a file stream of documents.

The measured tool has no streaming; this module only runs the existing batch
operators on new documents as they land. Mining is per document, so each
micro-batch is mined exactly with the batch plan (``foreachBatch``). Every
epoch overwrites its own output folder, so a replay after a failure rewrites
the same rows instead of appending duplicates; progress is kept in the
checkpoint location (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stereoscope.operators.mining import counterfactual_pairs, mine_sentences, split_sentences
from stereoscope.operators.pairs import pair_labels

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def document_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(DOCUMENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def labelled_pairs_of(docs: DataFrame, spec_terms: DataFrame) -> DataFrame:
    mined = mine_sentences(split_sentences(docs), spec_terms)
    return pair_labels(counterfactual_pairs(mined, spec_terms), spec_terms)


def start_mining(spark: SparkSession, source_path: str, spec_terms: DataFrame, out_path: str,
                 checkpoint_location: str, available_now: bool = True, processing_time: str | None = None):
    """Start the query; returns the StreamingQuery. Output: labelled pairs, one folder per epoch."""

    def each(batch: DataFrame, epoch_id: int) -> None:
        (labelled_pairs_of(batch, spec_terms).withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}"))

    w = document_stream(spark, source_path).writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
