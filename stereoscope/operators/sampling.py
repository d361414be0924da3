"""Seeded sampling and skew-safe ordering helpers.

Random choices are orders by ``md5(seed|key...)``: reproducible, and the same
text in Spark and DuckDB. Top-n per group with a literal n uses ``row_number() <= n``,
which the optimizer turns into a partial (map-side) window group limit, so a hot
group ships at most n rows per input partition. Per-group targets (n a column) and
dense ordinals come from range partitions (``operators.ordinals``), so no group is
sorted by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.keys import seeded_int, seeded_rank
from stereoscope.operators.ordinals import ordinal_within
from stereoscope.sources.specs import bounded


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n, out: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows of each group (``n`` an int or a column)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    n_col = n if not isinstance(n, int) else F.lit(n)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n_col)


ENOUGH = 16  # times the wanted rows that a sample's first cut expects


def hex_share(hex_col: Column) -> Column:
    """An md5 hex text as a fraction in [0, 1), in the same order (by its first 8 digits)."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def top_n_by_rank(df: DataFrame, group_cols: list[str], rank_hex: Column, n, out: str = "rank") -> DataFrame:
    """Rows with the ``n`` smallest hex ranks per group, ``n`` a column (per-group targets).

    Exact and skew-safe: a rank is a uniform hash, so in a group of c rows only those below the share ``ENOUGH * n / c``
    are numbered; groups that this leaves with fewer than n rows (hardly ever) are numbered whole. Ordinals
    come from range partitions, so no task holds a group."""
    d = df.withColumn("_h", rank_hex).withColumn("_n", n).where(F.col("_n") > 0)
    share = hex_share(F.col("_h"))
    counts = d.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_c"))
    d = d.join(counts, group_cols).withColumn("_low", share * F.col("_c") < F.col("_n") * F.lit(float(ENOUGH)))
    short = (d.groupBy(*group_cols).agg(F.sum(F.col("_low").cast("int")).alias("_l"), F.max("_n").alias("_w"), F.max("_c").alias("_all"))
             .where(F.col("_l") < F.least("_w", "_all")).select(*group_cols))
    d = d.where("_low").unionByName(d.where(~F.col("_low")).join(short, group_cols, "left_semi")).drop("_low", "_c")
    return ordinal_within(d, group_cols, ["_h"], out=out).where(F.col(out) <= F.col("_n")).drop("_h", "_n")


def balance_lists(spec_terms: DataFrame, seed: int = 0) -> DataFrame:
    """Per (spec, axis), sample the longer side down to the shorter length (seeded order),
    renumbering ``pos`` on the sampled side; equal lengths are untouched."""
    sz = spec_terms.groupBy("spec", "axis", "side").agg(F.count(F.lit(1)).alias("n"))
    m = sz.groupBy("spec", "axis").agg(F.min("n").alias("m"))
    j = spec_terms.join(sz, ["spec", "axis", "side"]).join(m, ["spec", "axis"])
    w = Window.partitionBy("spec", "axis", "side").orderBy(seeded_rank(seed, "spec", "axis", "side", "term", "pos"))
    r = j.withColumn("r", F.row_number().over(w))
    keep = (F.col("n") == F.col("m")) | (F.col("r") <= F.col("m"))
    newpos = F.when(F.col("n") == F.col("m"), F.col("pos")).otherwise(F.col("r") - 1).cast("int")
    return r.where(keep).select("spec", "axis", "side", "side_name", newpos.alias("pos"), "term")


def limit_lists(spec_terms: DataFrame, n: int = P.PREFILL_TERMS) -> DataFrame:
    """Keep the first ``n`` terms of each list."""
    return spec_terms.where(F.col("pos") < n)


def sample_per_attribute(scored: DataFrame, n: int = P.BOOTSTRAP_PER_ATTRIBUTE, reps: int = 1, seed: int = 0,
                         key: str = "pair_id") -> DataFrame:
    """Per (rep, spec, model, attribute): n rows without replacement when the attribute
    has at least n rows, n draws with replacement when it has 1..n-1, none when empty."""
    g = ["spec", "model", "att_term"]
    # per-attribute counts: one row per attribute, broadcast after a size check so the join
    # keyed by attribute never shuffles a hot attribute into one partition
    cnt = bounded(scored.groupBy(*g).agg(F.count(F.lit(1)).alias("_cnt")))
    d = scored.join(cnt, g)
    every = F.sequence(F.lit(0), F.lit(reps - 1))
    rank = lambda rep: F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), F.col(key).cast("string")))
    # n of cnt rows: those whose rank, as a fraction, lies below ENOUGH * n / cnt. A row is copied only for the
    # repeats in which it can be drawn
    big, low_share = d.where(F.col("_cnt") >= n), F.lit(float(ENOUGH * n)) / F.col("_cnt")
    low = big.withColumn("rep", F.explode(F.filter(every, lambda r: hex_share(rank(r)) < low_share)))
    # where that leaves fewer than n (hardly ever), the whole group is ranked
    few = (cnt.where(F.col("_cnt") >= n).withColumn("rep", F.explode(every))
           .join(low.groupBy("rep", *g).agg(F.count(F.lit(1)).alias("_low")), ["rep", *g], "left")
           .where(F.coalesce("_low", F.lit(0)) < n).select("rep", *g))
    rest = big.join(few, g)
    low = low.unionByName(rest.where(hex_share(rank(F.col("rep"))) >= low_share).select(*low.columns)).withColumn("_h", rank(F.col("rep")))
    wo = top_n_per_group(low, ["rep"] + g, [F.col("_h")], n, out="draw").drop("_h")
    wo = wo.withColumn("draw", F.col("draw") - 1)
    small = d.where(F.col("_cnt") < n).withColumn("rep", F.explode(every))
    small = small.withColumn("_ord", F.row_number().over(Window.partitionBy("rep", *g).orderBy(key)) - 1)
    draws = (small.select("rep", *g, "_cnt").distinct()
             .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
             .withColumn("_ord", F.pmod(seeded_int(seed, "rep", *g, "draw"), F.col("_cnt"))))
    wr = small.join(draws.drop("_cnt"), ["rep", *g, "_ord"]).drop("_ord")
    return wo.drop("_cnt").unionByName(wr.drop("_cnt"))


def spec_attribute_rows(scored: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """Rows relabelled to the spec attribute they stand for: each spec attribute takes the rows
    of its exact spelling, or, when it has none, the rows of its dashed spelling (the measured
    tool's bootstrap lookup). Other spellings drop out."""
    from stereoscope.functions.keys import dashed
    atts = spec_terms.where(F.col("axis") == "attribute").select("spec", F.col("term").alias("spec_att")).distinct()
    present = scored.groupBy("spec", "model", "att_term").agg(F.count(F.lit(1)).alias("_n"))
    exact = present.select("spec", "model", F.col("att_term").alias("spec_att"), F.lit(1).alias("_exact"))
    choice = (bounded(atts).join(bounded(present.select("spec", "model").distinct()), "spec")
              .join(exact, ["spec", "model", "spec_att"], "left")
              .withColumn("att_term", F.when(F.col("_exact") == 1, F.col("spec_att")).otherwise(dashed("spec_att")))
              .select("spec", "model", "att_term", "spec_att"))
    return (scored.join(bounded(choice), ["spec", "model", "att_term"])
            .withColumn("att_term", F.col("spec_att")).drop("spec_att"))


def bootstrap_score(scored: DataFrame, reps: int = P.BOOTSTRAP_REPEATS, n: int = P.BOOTSTRAP_PER_ATTRIBUTE,
                    seed: int = 0, spec_terms: DataFrame | None = None) -> DataFrame:
    """Per repeat, the macro Stereotype Score of an n-per-attribute sample; then
    mean, standard deviation and the 2.5% / 97.5% percentiles over repeats. With
    ``spec_terms``, the sampling units are the spec's attributes (``spec_attribute_rows``)."""
    if spec_terms is not None:
        scored = spec_attribute_rows(scored, spec_terms)
    s = sample_per_attribute(scored, n, reps, seed)
    per_att = s.groupBy("rep", "spec", "model", "att_term").agg(F.avg("stereotyped").alias("a"))
    per_rep = per_att.groupBy("rep", "spec", "model").agg(F.avg("a").alias("score"))
    return per_rep.groupBy("spec", "model").agg(
        F.count(F.lit(1)).alias("n_reps"),
        F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.stddev_samp("score"), 6).alias("std"),
        F.round(F.percentile("score", 0.025), 6).alias("p025"),
        F.round(F.percentile("score", 0.975), 6).alias("p975"))
