"""Exact ordinals within groups, without a task that holds a group and without cut points on the driver.

Rows are range-partitioned by group and order and sorted inside the partitions, so a group's rows follow
each other through them. A row's place in its partition is known as it is written; a small table, one row
per partition and group that meet, adds what lies before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoscope import session
from stereoscope.session import materialize

PER_PARTITION = 4  # ranges per shuffle partition: a piece is that much smaller than a partition


def _columns(names: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def ordinal_within(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "ordinal") -> DataFrame:
    """``df`` plus ``out``: each row's 1-based place in its group by ``order_cols`` (rows that tie take either place).

    The rows are written twice (checkpoints): as they come, since the range partitions' bounds are drawn from them before they
    are dealt and would else make them a second time, and in order, so their places survive a lost executor."""
    spark = df.sparkSession
    n = PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_columns(group_cols), *_columns(order_cols)]
    rows = materialize(session.materialize(df).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))  # the number of the partition is in the upper bits
    pieces = rows.groupBy("_part", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_part").alias("_p"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(starts, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias(out))
