"""Filter interactions, document sketches and periodic runs against plain versions of the same."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stereoscope.llm import edits, filter_audit, iblt, periodic_runs, queries

from .conftest import ODD, SF

WORD = r"[^\x20\x09-\x0D]+"


# --- filter interactions


def test_weights_are_the_mean_over_orders():
    rng = random.Random(3)
    for n in (2, 3, 4, 5):
        value = [Fraction(0)] + [Fraction(rng.randrange(1000)) for _ in range((1 << n) - 1)]
        for f, row in enumerate(filter_audit.shapley_weights(n)):
            orders = list(itertools.permutations(range(n)))
            plain = Fraction(0)
            for o in orders:
                before = sum(1 << g for g in o[:o.index(f)])
                plain += value[before | 1 << f] - value[before]
            assert sum(w * v for w, v in zip(row, value)) == plain / len(orders)


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    said = lambda i, k: i is not None and any(r[0] == i and r[k] == 1 for r in labels)
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and first[t] < i}
        docs.append((lang or "", fails, said(i, 1), said(i, 2)))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            mine = left
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(d[1][f] for d in mine) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine),
                                                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    conditions = {"A": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) < 200,
                  "B": 100 * F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))) < 50 * F.regexp_count("text", F.lit(WORD)),
                  "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.char_length("text"), "D": F.col("text").rlike("[#$%&*|]")}
    out = filter_audit.audit(docs, labels, conditions, repeats="E").collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(got) == len(out)
    return got


def test_audit_against_brute_force(spark, odd, none, clashing):
    told = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (7, 1, 0), (None, 1, 1), (8, None, 1), (99, 1, 1), (9, 0, 0)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    want = brute_audit([r[:3] for r in ODD], told)
    assert audited(odd, labels) == want
    assert audited(clashing, labels) == want
    assert audited(odd, labels.limit(0)) == brute_audit([r[:3] for r in ODD], [])
    assert audited(none, labels) == {}
    hot = odd.unionByName(spark.range(100, 400).selectExpr("id as doc_id", "'The cat sat on the mat today' as text", "'en' as lang", "'a' as source", "1L as n_chars"))
    rows = [r[:3] for r in ODD] + [(i, "The cat sat on the mat today", "en") for i in range(100, 400)]
    assert audited(hot, labels) == brute_audit(rows, told)


def test_audit_names_are_checked(spark, odd, labels):
    for conditions in ({"A": F.lit(True)}, {"A": F.lit(True), "BB": F.lit(True)}, {c: F.lit(True) for c in "ABCDEFG"}):
        with pytest.raises(ValueError):
            filter_audit.audit(odd, labels, conditions)


# --- sketches


def brute_paragraphs(text):
    return set(re.findall(iblt.PARAGRAPH, text))


def brute_versions(rows):
    """doc_id, text, edited text, next text of rows with different ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        gone = len(t) // 4
        yield i, t, t[:len(t) - gone] + after[:gone], after


def brute_likeness(a, b):
    a, b = brute_paragraphs(a), brute_paragraphs(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints_against_brute_force(spark, small):
    got = {r.doc_id: r for r in queries.op12_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(small[1])
    prints = {}
    for i, text, edit, after in brute_versions(small[1]):
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.near_edited == pytest.approx(brute_likeness(text, edit), abs=1e-12)
        assert r.near_next == pytest.approx(brute_likeness(text, after), abs=1e-12)
        for t, p in ((text, r.fingerprint), (edit, r.edited_fingerprint)):
            assert prints.setdefault(t, p) == p
            assert len(p) <= 36 * iblt.CELLS and sum(int(p[k + 4:k + 12], 16) for k in range(0, len(p), 36)) == 3 * len(brute_paragraphs(t))
    assert len(set(prints.values())) > 0.9 * len({frozenset(brute_paragraphs(t)) for t in prints})


def test_differences_are_recovered_whatever_their_size(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k, (n, more) in enumerate([(0, 0), (0, 5), (5, 0), (3, 3), (40, 2), (40, 200), (1000, 3), (2, 3000), (500, 500)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(60)]):
        both = {rng.getrandbits(63) for _ in range(n)}
        left, right = both | {rng.getrandbits(63) for _ in range(more // 2)}, both | {-rng.getrandbits(63) for _ in range(more - more // 2)}
        rows.append((k, sorted(left), sorted(right)))
        want[k] = {(d, 1) for d in left - right} | {(d, -1) for d in right - left}
    df = iblt.bucketed(spark.createDataFrame(rows, "k long, a array<long>, b array<long>"), ["k"], "t")
    out = iblt.differences(df, ["k"], "a", {"ab": "b", "aa": "a"}).collect()
    assert len(out) == 2 * len(rows)
    for r in out:
        assert len(r.found) == r.n_found and {(f.digest, f.n) for f in r.found} == (want[r.k] if r.pair == "ab" else set())
    assert max(r.m for r in out) > iblt.CELLS  # some were tried again
    assert iblt.differences(df.limit(0), ["k"], "a", {"ab": "b"}).count() == 0


def test_versions_of_odd_rows(spark, odd, none, clashing):
    for docs in (odd, clashing):
        out = edits.versions(docs).collect()
        assert len(out) == len(ODD) and len({(r.k1, r.k2) for r in out}) == len(ODD)
        assert sorted(r.n_chars for r in out) == sorted(len(t or "") for _, t, *_ in ODD)
        long = next(r for r in out if r.id == 6)
        assert long.n_chars == 130001 and len(long.own) == len(brute_paragraphs(ODD[5][1])) == 8
    assert edits.versions(none).count() == 0
    one = edits.versions(odd.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].own == one[0].next
    t = ODD[10][1]
    assert one[0].edited_sha256 == hashlib.sha256((t[:len(t) - len(t) // 4] + t[:len(t) // 4]).encode()).hexdigest()


def test_sketches_of_bucketed_rows_are_not_shuffled(spark):
    df = iblt.bucketed(spark.range(50).selectExpr("id as k", "array(id) as a", "array(id + 1) as b"), ["k"], "t")
    cells = iblt.sketch(df.select("k", "a"), ["k"], F.lit(24), "a")
    assert "Exchange" not in iblt.peel(cells, ["k"])._jdf.queryExecution().executedPlan().toString()


# --- periodic runs


def brute_runs(w, least):
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] == w[i + q] and (i == 0 or w[i - 1] != w[i - 1 + q]):
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                long = j + q - i
                part = w[i:i + long]
                if long >= max(least, 2 * q) and not any(all(part[k] == part[k + r] for k in range(long - r)) for r in range(1, q)):
                    out.append((i, long, q))
                i = j
            i += 1
    return sorted(out)


def random_words(rng):
    w = [b"%d" % rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.5 and w:
        w = w[:rng.randint(0, 10)] + w[:rng.randint(1, 8)] * rng.randint(1, 6) + w[:rng.randint(0, 5)]
    return w


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        least = rng.choice([2, 3, 4, 5, 12, 12])
        assert periodic_runs.runs_of_all(docs, least) == [brute_runs(w, least) for w in docs]


def test_documents_apart_share_nothing(monkeypatch):
    """Equal documents side by side make no run, however they are put together."""
    docs = [[b"a", b"b", b"c"] * 2] * 7 + [[]] + [[b"x"] * 30, [b"a", b"b"] * 9]
    want = [brute_runs(w, 12) for w in docs]
    assert periodic_runs.runs_of_all(docs, 12) == want
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", 5)
    assert periodic_runs.runs_of_all(docs, 12) == want


def test_long_runs_take_little_time():
    assert periodic_runs.runs_of_all([[b"a"] * 50_000], 12) == [[(0, 50_000, 1)]]
    unit = [b"%d" % k for k in range(701)]
    assert periodic_runs.runs_of_all([unit * 60 + unit[:100]], 12) == [[(0, 701 * 60 + 100, 701)]]


def test_runs_of_odd_rows(spark, odd, none, clashing):
    for docs in (odd, clashing):
        out = periodic_runs.with_runs(docs).collect()
        assert len(out) == len(ODD)
        long = next(r for r in out if r.doc_id == 6)
        assert [tuple(x) for x in long.runs] == [(1, 20000, 1)] and long.collapsed == "x" * 30000 + " word"
        assert all(r.runs == [] for r in out if r.doc_id != 6)
        assert {r.doc_id: r.text for r in out if r.doc_id}[8] == ODD[10][1] and {r.doc_id: r.text for r in out if r.doc_id}[3] is None
    assert periodic_runs.with_runs(none).count() == 0
    mine = odd.withColumn("runs", F.lit("mine"))
    assert periodic_runs.with_runs(mine, collapsed_out="short").columns == [*odd.columns, "runs", "short"]


def test_periodic_runs_query(spark, small):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(small[1])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    some = 0
    for i, text in small[1]:
        w = re.findall(WORD, text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 1500 and h % 10:  # the plain version takes the square of the length
            continue
        runs = brute_runs(w, 12)
        some += bool(runs)
        r = got[i]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs))
        gone = {k for s, long, q in runs for k in range(s + q, s + long)}
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert some > 5
