"""Mixing sources to target weights by systematic sampling.

Each source has a target size; every document of it is expected ``target / source size`` times. Along a
fixed order the expected copies are summed, one offset per source in [0, 1) is added, and a document is
emitted once for each whole number that the sum crosses at it. The order goes by size, so long and short
documents are taken alike and the words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, located, n_words, on_files, staged
from .prefix import global_prefix

MOST = 2  # no target above so many times its source's size


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float = MOST) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) plus ``target``.

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the rest is shared anew among
    the others. That fixed point is ``min(most * size, level * weight)`` with one level for all, found by
    summing along the sources in the order in which they fill up. One row per source; sums are made by
    range partitions, so many sources are no burden. A source of size 0 has target 0.
    """
    numbered, _ = global_prefix(sizes.withColumn("_one", F.lit(1).cast("long")), [F.col("source").isNull().cast("int"), F.col("source").cast("binary")], {"_rank": "_one"})
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    full = numbered.select("source", "source_size", weigh.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap"), F.col("_rank"))
    summed, _ = global_prefix(full, [F.col("_cap") / F.col("_w"), F.col("_rank")], {"_caps": "_cap", "_ws": "_w"})
    whole = full.agg(F.struct((F.sum("source_size") * F.lit(float(share))).alias("all"), F.sum("_w").alias("w"))).scalar()
    levels = summed.withColumn("_level", (whole["all"] - F.col("_caps")) / (whole["w"] - F.col("_ws")))
    open_ = levels.filter(F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = open_.agg(F.min(F.struct((F.col("_cap") / F.col("_w")).alias("at"), "_rank", "_level"))["_level"]).scalar()
    target = F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap"))
    return full.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    low = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null")))), 1, 8), 16, 10).cast("long")
    return low / F.lit(float(1 << 32))


def copies(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), seed: int = 7,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", place: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``source``, ``size`` (words; null text 0), ``source_size``, ``target``
    and ``copies`` (how often the mix emits it, at most ``MOST``), with ``_hash`` (of the text) and the
    columns ``place``, which tell fully equal rows apart where they are given.

    Null sources form one source, the last. Rows are ordered by size, then by id
    and text, so reruns and recomputed tasks agree; fully equal rows may take either place. Documents
    without words expect as many copies as any other of their source and take no words. A source without
    words, and an empty table, give no copies.
    """
    text = F.col(text_col).cast("string")
    sized = staged(docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"),
                               F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("_hash"), *place), "sizes")
    targets = staged(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights), "targets")
    order = [F.col("size"), F.col(id_col), F.col("_hash"), *map(F.col, place)]
    ranked, _ = global_prefix(sized.withColumn("_one", F.lit(1).cast("long")), order, {"_rank": "_one"}, group=["source"])
    joined = ranked.alias("d").join(F.broadcast(targets).alias("t") if few(targets) else targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("d.source"), seed)
    n = F.floor(start + (F.col("d._rank") + 1) * rate) - F.floor(start + F.col("d._rank") * rate)
    return joined.select(F.col(f"d.{id_col}"), "d.source", "d.size", "t.source_size", "t.target", n.cast("int").alias("copies"), "d._hash", *[F.col(f"d.{p}") for p in place])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; all columns stay.

    Each row is told by its place in the files, so rows equal in id, source and text, however many, are taken
    one by one like any others. An empty table, and one whose texts have no words, gives no rows.
    """
    docs, place = on_files(docs), ("_file", "_row")
    own = located(docs).select(*[F.col(f"_doc.`{c}`").alias(c) for c in dict.fromkeys((id_col, text_col, source_col))], *place)
    taken = copies(own, id_col=id_col, text_col=text_col, source_col=source_col, place=place, **how).filter("copies > 0").select(*place, "copies")
    both = located(docs).join(taken, list(place))
    return both.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")
