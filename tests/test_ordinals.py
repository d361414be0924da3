"""Ordinals within groups from range partitions."""

from pyspark.sql import functions as F

from stereoscope.operators.ordinals import ordinal_within
from stereoscope.operators.sampling import top_n_by_rank


def test_ordinals_of_a_hot_group_in_small_pieces(spark):
    """400,000 rows, a third of them in one group: exact places, and no task numbers over 50,000 rows."""
    n = 400_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 97).cast("string")).alias("g"),
                               F.xxhash64("id").alias("x"), F.when(F.col("id") % 2 == 0, F.lit(1)).alias("y"))
    out = ordinal_within(df, ["g"], ["y", "x"], out="no")
    assert out.columns == ["g", "x", "y", "no"]
    got = out.toPandas().sort_values(["g", "no"], na_position="first")
    assert len(got) == n
    for g, rows in got.groupby("g", dropna=False):
        assert rows["no"].tolist() == list(range(1, len(rows) + 1))
        key = rows["y"].notna().astype(int).tolist(), rows["x"].tolist()
        assert sorted(zip(*key)) == list(zip(*key))
    from stereoscope.operators import ordinals
    held = []
    real = ordinals.materialize
    try:
        ordinals.materialize = lambda d: held.append(real(d)) or held[-1]
        ordinal_within(df, ["g"], ["y", "x"])
    finally:
        ordinals.materialize = real
    sizes = [r["count"] for r in held[0].groupBy(F.shiftright("_at", 33).alias("p")).count().collect()]
    assert max(sizes) <= 50_000 and sum(sizes) == n


def test_ordinals_of_an_empty_table(spark):
    assert ordinal_within(spark.range(0).withColumn("g", F.lit(1)), ["g"], ["id"]).count() == 0


def test_top_n_by_rank_is_exact(spark):
    """Targets of 0, below, at and above a group's size; also where the first cut is short."""
    df = spark.range(30_000).select("id", (F.col("id") % 4).alias("g"), F.when(F.col("id") % 4 == 3, F.lit(0)).when(F.col("id") % 4 == 2, F.lit(9_000))
                                    .when(F.col("id") % 4 == 1, F.lit(7)).otherwise(F.lit(400)).alias("n"))
    skewed = F.when((F.col("g") == 1) & (F.col("id") > 20), F.concat(F.lit("f"), F.md5(F.col("id").cast("string")))).otherwise(F.md5(F.col("id").cast("string")))
    for rank in (F.md5(F.col("id").cast("string")), skewed):
        got = sorted((r.g, r.k, r.id) for r in top_n_by_rank(df, ["g"], rank, F.col("n"), out="k").collect())
        rows = df.withColumn("h", rank).collect()
        want = []
        for g in range(4):
            mine = sorted((r.h, r.id, r.n) for r in rows if r.g == g)
            want += [(g, k + 1, i) for k, (_, i, n) in enumerate(mine) if k < n]
        assert got == sorted(want)
