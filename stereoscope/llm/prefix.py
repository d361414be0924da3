"""Global prefix sums without a global window.

Rows are range-partitioned by the order, each row keeps the number of its partition, partitions are
totalled (one small row per partition and group), the totals are summed over the partitions before, and
a window inside one partition adds the rest. No task sees more than one partition's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] | None = None,
                  parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` plus, for each ``sums`` item ``name: column``, the sum of ``column`` over all rows of the
    group before this one in ``order`` (exclusive, so 0 for the first). The second result has the totals
    ``_t_name`` per partition and group.

    ``df`` should be narrow: it is written once to the shared folder, so partition numbers survive a
    retry. ``order`` must tell rows apart as far as their order matters: rows that tie may take either
    order. A null sums as 0. An empty input gives an empty result.
    """
    group = group or []
    key = [F.col(g) for g in group]
    ranged = df.repartitionByRange(parts, *key, *order) if parts else df.repartitionByRange(*key, *order)
    tagged = staged(ranged.withColumn("_part", F.spark_partition_id()), "prefix")
    totals = tagged.groupBy("_part", *group).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_t_{n}") for n, c in sums.items()])
    # one row per partition and group that occurs in it
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()])
    cond = F.col("l._part") == F.col("b._part")
    for g in group:
        cond = cond & F.col(f"l.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = local.alias("l").join(base.alias("b"), cond, "left")
    rows = joined.select(*[F.col(f"l.`{c}`") for c in df.columns], *[(F.col(f"l._l_{n}") + F.col(f"b._b_{n}")).alias(n) for n in sums])
    return rows, totals
