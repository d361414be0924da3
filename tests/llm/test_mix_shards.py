import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stereoscope.llm import mixing, sharding

from .conftest import ODD


def brute_targets(sizes, share, weights):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(df, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = brute_targets(dict(sizes), 1.5, (3, 1, 2))
    got = mixing.copies(df).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in got) == sorted((str(i), size(t), sizes[s]) for i, t, s in rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:  # rows go by size, so a source is off by its longest document at most
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(df).collect()))
    return got


def test_mix_of_the_tables(spark, small):
    check_mix(small[0], [(r.doc_id, r.text, r.source) for r in small[0].collect()])


def test_mix_of_odd_rows(spark, odd, none, clashing):
    got = check_mix(odd, [(r[0], r[1], r[3]) for r in ODD])
    assert mixing.copies(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r["copies"] for r in got)


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 50, None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, 1.5, (3, 1, 2)).collect()}
    assert got == pytest.approx(brute_targets(sizes, 1.5, (3, 1, 2)))
    assert mixing.source_targets(df.limit(0), 1.5, (3, 1, 2)).count() == 0


def test_copies_follow_expectation(spark):
    """Over 3000 equal documents a rate of 1.5 is met to the document, and nobody is taken thrice."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    n = collections.Counter(r["copies"] for r in mixing.copies(df).collect())
    assert n == {1: 1500, 2: 1500}


def test_a_row_repeated_often_is_mixed_like_others(spark):
    """Fully equal rows, a null id among them, are emitted as often as their copies say; no window holds the texts."""
    same = spark.range(0, 2000, 1, 4).selectExpr("cast(null as long) as doc_id", "'one two three' as text", "'s' as source", "id % 2 as extra")
    rest = spark.range(0, 1000, 1, 4).selectExpr("id as doc_id", "'four five' as text", "if(id % 2 = 0, 's', 't') as source", "0L as extra")
    df = same.unionByName(rest)
    want = collections.Counter()
    for r in mixing.copies(df).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.mixed(df)
    got = collections.Counter(r["doc_id"] for r in out.collect())
    assert got == +want and out.columns == df.columns
    assert got[None] > 2000 and out.filter("doc_id is null").select("extra").distinct().count() == 2
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def check_shards(df, rows, n):
    got = sharding.shards(df, n).collect()
    want = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    got = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in got] == want  # contiguous in this order
    bytes_, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values()) and all(0 <= s < n for s in slots)
    total, largest = sum(w[3] for w in want), max(w[3] for w in want)
    assert all(abs(b - total / n) <= largest for b in bytes_.values())


def test_shards(spark, small, odd, none):
    check_shards(small[0], small[1], 16)
    check_shards(small[0], small[1], 3)
    check_shards(odd, [(r[0], r[1]) for r in ODD], 4)
    assert sharding.shards(none, 16).count() == 0
