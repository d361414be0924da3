"""Contiguous shards of near equal bytes.

Rows stand in id order. A row's place is the bytes of all rows before it (prefix sums over the totals of
range partitions); the total is cut at equal targets, and a row goes to the shard in which its middle
byte lies. So shards are contiguous, and each is off its target by at most one row's bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .prefix import global_prefix


def shards(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes of the text plus 1; null text: 1), ``text_crc32``,
    ``shard`` (0 to n-1) and ``slot`` (its place in the shard, gapless from 0).

    Null ids come first; rows with equal ids are told apart by their text's crc32 and size, and fully equal
    rows may take either place. Every shard number need not occur when there are fewer rows than shards.
    An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    sized = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("_one"))
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed, totals = global_prefix(sized, order, {"_before": "size", "_rank": "_one"})
    total = totals.agg(F.sum("_t__before").alias("_total")).scalar()
    # a row's middle byte, twice counted to stay in whole numbers
    cut = placed.withColumn("shard", F.call_function("div", (2 * F.col("_before") + F.col("size")) * int(n), 2 * total).cast("int"))
    first = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n rows
    return cut.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
