"""SparkSession settings used by tests, bench and examples.

On a cluster the session comes from the launcher; these helpers only fill in
settings that are unset. ``checkpoint_dir`` returns the shared folder named by
``spark.checkpoint.dir``; a scratch folder is chosen only where none is set
and the master is local.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE for runtime re-planning (coalescing,
# skew-join splitting, broadcast conversion from measured sizes) and Arrow for
# the one Python batch path (the inference hook).
#
# Broadcast policy: no broadcast from plan estimates (they undercount aggregates
# over exploded text); a join side is broadcast either by an explicit hint on a
# spec-sized table whose row count was checked (sources.specs.bounded), or by
# AQE after the side's shuffle output was materialized and measured below the
# adaptive threshold.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # small shuffles feed CPU-heavy text work: keep them in several partitions
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    # checkpointed intermediates are removed once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stereoscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder that ``spark.checkpoint.dir`` names. Only a local master may go
    without: it gets a scratch folder. Elsewhere executors do not share one, so a setting is required."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not re.match(r"local(\[[^\[\]]*\])?$", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="stereoscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return d


def materialize(df):
    """Cut the lineage of an intermediate that several consumers read: a reliable checkpoint in
    the shared checkpoint folder (survives executor loss; never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
