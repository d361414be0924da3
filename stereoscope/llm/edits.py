"""Versions of each document for fingerprints: the text, an edited text that ends like the next one begins, the next text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import located, on_files, staged
from .iblt import digests
from .prefix import global_prefix


def versions(docs: DataFrame, cut: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``k1``, ``k2`` (its key: 128 bits of a hash of its place in the files), ``id``, ``n_chars``, ``edited_sha256``, and
    the paragraph digests ``own``, ``edited``, ``next``.

    In the edited text the last ``n_chars // cut`` code points are replaced by the first as many (or all) of the next
    document by ascending id; after the last comes the first, so a single document is its own next. Null ids come
    first; rows of one id stand in order of a hash of their text, equal rows in either order. A null text is empty, and has nothing to replace.
    Texts move once: the order is found on ids and lengths, the next text's part and digests go to
    the row's key, and its join reads the same shuffle. Extra columns are not read. An empty table gives no rows.
    """
    at = located(on_files(docs))
    key = [F.xxhash64("_file", "_row").alias("k1"), F.xxhash64("_row", "_file").alias("k2")]
    texts = at.select(*key, F.coalesce(F.col(f"_doc.`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"_doc.`{id_col}`").cast("long").alias("id"))
    narrow = texts.select("k1", "k2", "id", F.xxhash64("text").alias("hash"), F.char_length("text").cast("long").alias("n_chars"), F.lit(1).cast("long").alias("_one"))
    ranked, _ = global_prefix(narrow, [F.col("id").asc_nulls_first(), F.col("hash"), F.col("k1"), F.col("k2")], {"rank": "_one"})
    ranked = staged(ranked.select("k1", "k2", "id", "n_chars", "rank"), "ranked")
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    after = ranked.select(F.pmod(F.col("rank") - 1 + n, n).alias("rank"), F.col("k1").alias("next1"), F.col("k2").alias("next2"))
    order = ranked.join(after, "rank").drop("rank")
    plain = texts.select("k1", "k2", "text")
    theirs = plain.withColumnsRenamed({"k1": "next1", "k2": "next2"}).join(order, ["next1", "next2"])
    gone = F.floor(F.col("n_chars") / cut).cast("int")
    theirs = theirs.select("k1", "k2", "id", "n_chars", F.substring("text", F.lit(1), gone).alias("head"), digests(F.col("text")).alias("next"))
    both = plain.join(theirs, ["k1", "k2"])
    both = both.withColumn("edit", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - gone).cast("int")), "head"))
    return both.select("k1", "k2", "id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("own"),
                       digests(F.col("edit")).alias("edited"), "next")
