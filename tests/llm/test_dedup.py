import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stereoscope.llm import components, exact_dedup, simhash
from stereoscope.llm import common
from stereoscope.llm.common import on_files, work_dir

from .conftest import ODD


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    return {k: (min(v), len(v)) for k, v in groups.items()}


def check(spark, df, rows, **how):
    got = exact_dedup.decisions(df, **how).select(F.when(~F.col("rank.no_id"), F.col("rank.id")).alias("id"), "best.id", "n", "kept", F.lower(F.hex("digest")).alias("d")).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(want[normal(t)])
    for r in got:
        assert (r[1], r["n"]) in [(w[0][2], w[1]) for w in by_id[r[0]]]
    assert sum(r["kept"] for r in got) == len(want)
    return got


def test_decisions_match_brute_force(spark, small):
    df, rows = small
    got = check(spark, df, rows)
    texts = dict(rows)
    assert all(r["d"] == hashlib.sha256(normal(texts[r[0]]).encode()).hexdigest() for r in got)


def test_odd_rows(spark, odd):
    check(spark, odd, [(r[0], r[1]) for r in ODD])


def test_equal_digests_are_told_apart_by_bytes(spark, small, odd):
    """With a digest of two values nearly every hit clashes; the groups are right all the same."""
    weak = lambda c: F.unhex(F.lpad(F.hex(F.pmod(F.octet_length(c), F.lit(2))), 2, "0"))
    check(spark, odd, [(r[0], r[1]) for r in ODD], digest=weak)
    check(spark, small[0], small[1], digest=weak)


def test_no_rows(spark, none):
    assert exact_dedup.decisions(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0


def test_all_columns_stay(spark, clashing):
    out = exact_dedup.deduplicated(clashing)
    assert out.columns == clashing.columns
    assert out.count() == len(brute_groups([(r[0], r[1]) for r in ODD]))


def test_the_sieve_loses_no_place(spark, small, monkeypatch):
    """Every place put in is met, others only by chance; a tiny sieve, full of bits, changes no result."""
    rows = common.located(small[0])
    own = rows.filter("_doc.doc_id % 7 = 0").select("_file", "_row")
    met = {r["doc_id"]: r["_met"] for r in common.sifted(rows, common.sieve(own, "_file", "_row")).select("_doc.doc_id", "_met").collect()}
    assert len(met) == len(small[1]) and {i for i, m in met.items() if m} == {i for i, _ in small[1] if i % 7 == 0}
    monkeypatch.setattr(common, "SIEVE_BITS", 4)
    assert all(r["_met"] for r in common.sifted(rows, common.sieve(own, "_file", "_row")).filter("_doc.doc_id % 7 = 0").collect())
    check(spark, *small)
    assert exact_dedup.deduplicated(small[0]).count() == len(brute_groups(small[1]))


def test_only_texts_of_groups_are_compared(spark, monkeypatch):
    """Of a table with few copies, the texts of the groups alone are exchanged."""
    seen = {}

    def staged(df, name):
        seen[name] = common.staged(df, name)
        return seen[name]

    monkeypatch.setattr(exact_dedup, "staged", staged)
    df = spark.range(0, 1000, 1, 4).selectExpr("id as doc_id", "concat('text ', if(id % 100 = 0, -1, id)) as text")
    out = exact_dedup.deduplicated(df)
    assert out.count() == 991 and seen["compared"].count() == 10 and seen["dropped"].count() == 9


def test_state_goes_on_with_new_files(spark, odd):
    """A second batch of signatures meets the state that the first one left."""
    source, state = work_dir(spark, "t-sig"), work_dir(spark, "t-state")
    sig = exact_dedup.signatures(on_files(odd))
    sig.write.parquet(source)
    exact_dedup.advance(spark, source, state)
    sig.write.mode("append").parquet(source)
    exact_dedup.advance(spark, source, state)
    want = brute_groups([(r[0], r[1]) for r in ODD])
    got = exact_dedup.state_table(spark, state).select("n", "best.id").collect()
    assert sorted((r["n"], r["id"]) for r in got) == sorted((2 * n, best[2]) for best, n in want.values())


def brute_fingerprint(text, k=3):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [words[i:i + k] for i in range(len(words) - k + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in root}


def unsigned(x):
    return x % (1 << 64)


def check_groups(df, rows):
    got = simhash.near_groups(df).collect()
    assert len(got) == len(rows)
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = brute_components({f for _, f in fps})
    low = {}
    for i, f in fps:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(((r["doc_id"], unsigned(r["fp"]), r["component_id"]) for r in got), key=key) == sorted(((i, f, low.get(root[f])) for i, f in fps), key=key)
    return root, fps


def test_near_groups_match_brute_force(spark, small):
    check_groups(*small)


def test_near_groups_of_odd_rows(spark, odd, none, clashing):
    root, fps = check_groups(odd, [(r[0], r[1]) for r in ODD])
    assert simhash.near_groups(none).count() == 0
    out = simhash.one_of_each(clashing)
    assert out.columns == clashing.columns
    assert out.count() == len({root[f] for _, f in fps})


def test_crowded_segments_lose_no_link(spark, monkeypatch):
    """Fingerprints around a few centres, linked by pairs and by full variants alike."""
    import random
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(25):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_components(fps)
    want = {frozenset(f for f in want if want[f] == r) for r in set(want.values())}
    for crowd in (1000, 3):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        root = {unsigned(r["node"]): unsigned(r["root"]) for r in components.components(simhash.links(df)).collect()}
        got = {frozenset(f for f in fps if root.get(f, f) == r) for r in {root.get(f, f) for f in fps}}
        assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100)}


def below(plan):
    """A physical plan's nodes; of an adaptive one, those it began with."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    for i in range(plan.children().size()):
        yield from below(plan.children().apply(i))


@pytest.mark.parametrize("crowd", [1000, 2])
def test_no_exploded_rows_are_broadcast(spark, monkeypatch, crowd):
    """Spark takes exploded rows for as many as the rows they come from: as small as a broadcast at sizes where they are not."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    names = [f"spark.sql.{x}autoBroadcastJoinThreshold" for x in ("", "adaptive.")]
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "10MB")
        # values of the upper segment that eight fingerprints share
        fps = common.staged(spark.range(2000).select(F.shiftleft(F.xxhash64(F.floor(F.col("id") / 8)), 32).bitwiseOR(F.xxhash64("id").bitwiseAND((1 << 32) - 1)).alias("fp")).distinct(), "fps")
        plan = simhash.links(fps)._jdf.queryExecution().executedPlan()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    sent = [n for n in below(plan) if n.nodeName() == "BroadcastExchange"]
    assert [n.nodeName() for n in below(plan)].count("SortMergeJoin") == 1
    assert not any(x.nodeName() == "Generate" for n in sent for x in below(n))
    assert bool(sent) == (crowd == 2)  # the crowded values and what is beside them, whose size is known from files


def broadcast_sides(spark, make):
    """The broadcasts of the physical plan of what ``make`` gives, at Spark's own threshold."""
    names = [f"spark.sql.{x}autoBroadcastJoinThreshold" for x in ("", "adaptive.")]
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "10MB")
        plan = make()._jdf.queryExecution().executedPlan()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    return [n.toString() for n in below(plan) if n.nodeName() == "BroadcastExchange"]


def test_rows_with_places_are_not_broadcast(spark, small, monkeypatch):
    """A file's name is kept once in a file of places and is in every row of a broadcast: the rows grow with the documents."""
    own = broadcast_sides(spark, lambda: simhash.near_groups(common.located(small[0]).selectExpr("_doc.doc_id", "_doc.text", "_file", "_row"), keep=("_file", "_row")))
    assert not any("_file#" in x for x in own)
    for most in (100_000, 0):
        monkeypatch.setattr(exact_dedup, "FEW", most)
        sent = broadcast_sides(spark, lambda: exact_dedup.deduplicated(small[0]))
        assert sum("dropped" in x and "BitmapExpression" not in x and "bitmap" not in x for x in sent) == (1 if most else 0), sent
        assert exact_dedup.deduplicated(small[0]).count() == len(brute_groups(small[1]))
