import os
import tempfile

from conftest import SF_SMALL

from stereoscope.plans import flagship as FL
from stereoscope.streaming.mining import start_mining


def test_stream_mining_equals_batch(spark):
    out = tempfile.mkdtemp(prefix="stereoscope-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="stereoscope-stream-ckpt-")
    src = os.path.join(SF_SMALL, "documents*.parquet")
    q = start_mining(spark, src, FL.spec_table(spark), out, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == FL.labelled_pairs(spark, SF_SMALL).count()
    assert got.select("pair_id").distinct().count() == got.count()
