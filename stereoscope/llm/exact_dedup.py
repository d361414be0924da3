"""Exact deduplication with a disk-backed keyed state.

A structured stream reads small signature rows (digest, id, length, place of the content) and keeps one
state row per digest in RocksDB, without expiry: how many rows had it, and the best of them: its stable
identifier and the place of its content. New signature files can follow later: the same checkpoint goes
on. Partial sums are made before the shuffle, so a digest that a third of all rows share reaches its
state as one row per task. The state is then read back as a table.

A hit, a row whose digest is kept by another row, is compared byte for byte with the content at the kept
place. Where bytes differ under one digest, the rows of that digest are grouped by their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, located, on_files, sieve, sifted, staged, without_spaces, work_dir

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no 4 MB set aside for each store's log of files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
SPLIT = 2_000  # copies of a kept text that one task compares
FEW = 100_000  # places that may be broadcast: files keep a repeated file's name once, so Spark sizes them too low


def sha256(normal: Column) -> Column:
    return F.unhex(F.sha2(normal.cast("binary"), 256))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One small row per document: ``digest`` of the text without white space, ``rank`` (what orders equal
    texts: most code points, then smallest id, null ids last, then place)."""
    at = located(docs)
    text = F.coalesce(F.col(f"_doc.`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"_doc.`{id_col}`")
    rank = F.struct((-F.char_length(text)).alias("shorter"), id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).cast("long").alias("id"),
                    F.col("_file").alias("file"), F.col("_row").alias("row"))
    return at.select(digest(without_spaces(text)).alias("digest"), rank.alias("rank"))


def advance(spark: SparkSession, source: str, state: str) -> None:
    """Feed the signature files under ``source`` that the state has not seen, as a stream, and stop."""
    schema = spark.read.parquet(source).schema
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).parquet(source)
        kept = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
        kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, state: str) -> DataFrame:
    """The state: ``digest``, ``n`` rows, ``best`` (rank of the row that stays)."""
    kept = spark.read.format("statestore").load(state)
    n, best = kept.schema["value"].dataType.names
    return kept.select(F.col("key")[kept.schema["key"].dataType.names[0]].alias("digest"), F.col("value")[n].alias("n"), F.col("value")[best].alias("best"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per document: ``digest``, ``rank`` (its own), ``best`` (of the row that stays), ``n`` (rows
    in its group), ``kept``.

    Texts are equal when their bytes without white space are; null and empty texts are equal. Of equal
    texts the one with the most code points stays, then the smallest id; a null id is last and, like
    repeated rows with one id, is told apart by its place, so exactly one row of a group stays. An empty
    table gives no rows.
    """
    spark, docs = docs.sparkSession, on_files(docs)
    source, state = work_dir(spark, "signatures"), work_dir(spark, "dedup-state")
    signatures(docs, id_col, text_col, digest).write.parquet(source)
    own = spark.read.parquet(source)
    if own.isEmpty():
        return own.select("digest", "rank", F.col("rank").alias("best"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("kept"))
    advance(spark, source, state)
    # groups of one row need no join: only digests met more than once are looked up
    many = staged(state_table(spark, state).filter("n > 1"), "repeated")
    joined = own.join(many, "digest", "left")
    clash = _clashes(docs, text_col, joined)
    if not clash.isEmpty():
        joined = _by_bytes(docs, text_col, joined, clash)
    best = F.coalesce("best", "rank")
    return joined.select("digest", "rank", best.alias("best"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), (F.col("rank") == best).alias("kept"))


def _texts(docs: DataFrame, text_col: str, places: DataFrame) -> DataFrame:
    """``places`` (``file``, ``row`` and more) with the ``bytes`` of the text there. Only texts that the
    places' sieve lets through are exchanged."""
    text = F.coalesce(F.col(f"_doc.`{text_col}`").cast("string"), F.lit(""))
    near = sifted(located(docs), sieve(places)).filter("_met")
    texts = near.select(F.col("_file").alias("file"), F.col("_row").alias("row"), without_spaces(text).cast("binary").alias("bytes"))
    return places.join(texts, ["file", "row"])


def _clashes(docs: DataFrame, text_col: str, joined: DataFrame) -> DataFrame:
    """Digests under which a hit's bytes differ from the kept content's bytes.

    Only texts of groups with hits move, and those few that share a bit of the sieve with one. A kept text is
    sent once per ``SPLIT`` hits of its group, and each hit meets one of them, so no task holds a large group.
    """
    pieces = F.ceil(F.col("n") / SPLIT).cast("int")
    own = F.when(F.col("rank") != F.col("best"), F.pmod(F.xxhash64("rank"), pieces).cast("int"))
    members = joined.filter("n > 1").select("digest", F.col("rank.file").alias("file"), F.col("rank.row").alias("row"), pieces.alias("pieces"), own.alias("piece"))
    texts = staged(_texts(docs, text_col, staged(members, "members")), "compared")
    mine = texts.filter("piece is not null").select("digest", "piece", F.col("bytes").alias("mine"))
    theirs = texts.filter("piece is null").select("digest", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("bytes").alias("theirs"))
    return staged(mine.join(theirs, ["digest", "piece"]).filter("mine != theirs").select("digest").distinct(), "clashes")


def _by_bytes(docs: DataFrame, text_col: str, joined: DataFrame, clash: DataFrame) -> DataFrame:
    """Regroup the rows of digests that clash by their bytes; the rest stay as they are."""
    rows = joined.join(clash, "digest", "left_semi").select("digest", "rank", F.col("rank.file").alias("file"), F.col("rank.row").alias("row"))
    rows = _texts(docs, text_col, rows)
    groups = rows.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
    regrouped = rows.join(groups, "bytes").select("digest", "rank", "n", "best")
    return joined.join(clash, "digest", "left_anti").select("digest", "rank", "n", "best").unionByName(regrouped)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; all columns stay.

    Rows that the sieve of the dropped places does not meet stay where they are; only the others are exchanged.
    """
    docs = on_files(docs)
    place = [F.col("rank.file").alias("_file"), F.col("rank.row").alias("_row")]
    gone = staged(decisions(docs, id_col, text_col).filter("not kept").select(*place), "dropped")
    exact = gone if few(gone, FEW) else gone.hint("merge")
    rows = sifted(located(docs), sieve(gone, "_file", "_row"))
    checked = rows.filter("_met").join(exact, ["_file", "_row"], "left_anti")
    return rows.filter("not _met").select("_doc.*").unionAll(checked.select("_doc.*"))
