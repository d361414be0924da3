"""Learnt operators against a second, plain computation of what they learn and of every score."""

import collections
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stereoscope.llm import quality_qda, quality_rules, toxicity

from .test_text import SF1, brute_statistics


@pytest.fixture(scope="module")
def some(spark):
    """Documents, labels, and both as plain rows."""
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet").filter("doc_id < 1200"), spark.read.parquet(f"{SF1}/labels.parquet").filter("doc_id < 1200")
    return docs, labels, {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r for r in labels.collect()}


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_rates(text):
    s = brute_statistics(text)
    n, chars = max(1, s["n_words"]), max(1, s["word_chars"])
    lines = sum(any(c not in " \t\n\x0b\x0c\r" for c in line) for line in text.split("\n"))
    digits = sum(c in "0123456789" for c in text)
    upper = sum(c.isupper() and c.isalpha() for c in text)
    return [math.log1p(s["n_words"]), s["word_chars"] / n, math.log1p(100 * s["n_symbols"] / chars), math.log1p(100 * s["n_pipes"] / n), math.log1p(100 * s["n_bang"] / n),
            upper / chars, math.log1p(100 * digits / chars), s["n_distinct"] / math.sqrt(n), s["n_dup_lines"] / max(1, lines), s["n_repeat_words"] / n]


def test_quality_scores_from_a_plain_fit(some):
    """Statistics counted in Python, class moments from centred rows, densities by solve and determinant."""
    docs, labels, texts, marks = some
    ids = sorted(texts)
    x = np.array([plain_rates(texts[i]) for i in ids])
    y = np.array([marks[i]["quality"] if i in marks and marks[i]["quality"] is not None and remainder(i, 5) else -1 for i in ids])
    known = y >= 0
    scale = x[known].std(0)
    scale[scale < 1e-5] = 1.0
    z = (x - x[known].mean(0)) / scale
    share = {k: (y[known] == k).mean() for k in (0, 1)}
    cov = {k: np.cov(z[y == k].T, bias=True) for k in share}
    pooled = sum(share[k] * cov[k] for k in share)
    density = {}
    for k in share:
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.001 * np.eye(len(c))
        d = z - z[y == k].mean(0)
        density[k] = -0.5 * (d * np.linalg.solve(c, d.T).T).sum(1) - 0.5 * np.linalg.slogdet(c)[1] + math.log(share[k])
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    got = {r["doc_id"]: r for r in quality_qda.scored(docs, labels).collect()}
    assert sorted(got) == ids
    assert np.allclose([got[i]["score"] for i in ids], want, atol=1e-6)
    assert all(got[i]["held_out"] == (remainder(i, 5) == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i in ids)


def plain_list(rows, names):
    """The decision list of ``rows`` (dicts), each figure counted over the rows themselves."""
    cuts = {n: set() for n in names}
    for y in (0, 1):
        for n in names:
            values = sorted(r[n] for r in rows if r["y"] == y)
            cuts[n] |= {values[max(0, math.ceil(q * len(values)) - 1)] for q in quality_rules.QUANTILES if values}
    met = lambda r, rule: all(r[n] > t if above else r[n] <= t for n, above, t in rule)
    tally = lambda rs: (sum(r["y"] == 0 for r in rs), sum(r["y"] == 1 for r in rs))
    left, out = list(rows), []
    while len(out) < 12:
        grow, rule = [r for r in left if r["grow"]], []
        while len(rule) < 3:
            p0, n0 = tally(grow)
            best, chosen = 0.0, None
            for n in names:
                for t in sorted(cuts[n]):
                    for above in (False, True):
                        p, q = tally([r for r in grow if met(r, [(n, above, t)])])
                        if p >= 5 and p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0))) > best + 1e-9:
                            best, chosen = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0))), (n, above, t)
            if chosen is None:
                break
            rule.append(chosen)
            grow = [r for r in grow if met(r, [chosen])]
            if not tally(grow)[1]:
                break
        if not rule:
            break
        aside = [tally([r for r in left if not r["grow"] and met(r, rule[:k])]) for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda k: ((aside[k][0] - aside[k][1]) / max(1, sum(aside[k])), -k))
        if aside[k][0] < 5 or aside[k][0] < 0.95 * sum(aside[k]):
            break
        out.append(rule[: k + 1])
        left = [r for r in left if not met(r, out[-1])]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decision_list_from_plain_counts(spark, seed):
    """The learnt list, condition by condition. Values are coarse, so that cuts tie and repeat."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(600):
        a, b, c = (round(float(v), 2) for v in rng.random(3))
        bad = (a > 0.7 and b > 0.4) or c < 0.15 or rng.random() < 0.01
        rows.append({"a": a, "b": b, "c": c, "y": int(not bad), "grow": i % 3 != 0})
    want = plain_list(rows, ["a", "b", "c"])
    got = quality_rules.learn(spark.createDataFrame(rows, "a double, b double, c double, y int, grow boolean"), ["a", "b", "c"])
    assert want and [[(c.name, c.above, c.threshold) for c in r.conditions] for r in got] == want


def plain_entries(rows):
    """Entries and weights of ``rows`` (id, text, y): documents with one context count once."""
    groups = {}
    for i, text, y in rows:
        words = toxicity.folded_words(text)
        runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
        key = y, min(xxhash.xxh64_intdigest(r) for r in runs) if words else None
        if key not in groups or i < groups[key][0]:
            groups[key] = i, set(words)
    n = collections.Counter(y for y, _ in groups)
    counts = collections.defaultdict(lambda: [0, 0])
    for (y, _), (_, words) in groups.items():
        for w in words:  # each word counts once a document, also where words share a beginning
            for e in [f" {w} "] + [f" {w[:k]}" for k in (4, 5, 6, 7, 8) if len(w) >= k]:
                counts[e][y] += 1
    share = n[1] / (n[0] + n[1])
    found = {}
    for e, (clean, toxic) in counts.items():
        every = clean + toxic
        if toxic < max(5, math.log(1e-8) / math.log(share)) or toxic < 0.9 * every or toxic <= every * share:
            continue
        likely = toxic * math.log(toxic / every / share) + (clean * math.log(clean / every / (1 - share)) if clean else 0)
        if likely >= -math.log(1e-8):
            found[e] = clean, toxic
    kept = []
    for e in sorted(found, key=len):
        beyond = [found[f][1] for f in found if len(f) > len(e) and f.startswith(e)]
        if max(beyond, default=0) < 0.95 * found[e][1] and not any(e != k and e.startswith(k) for k in kept):
            kept.append(e)
    return {e: math.log((found[e][1] + 0.5) / (n[1] + 1)) - math.log((found[e][0] + 0.5) / (n[0] + 1)) for e in kept}


def test_lexicon_from_plain_counts(spark, some):
    docs, labels, texts, marks = some
    rows = [(i, texts[i], marks[i]["toxic"]) for i in sorted(texts) if i in marks and marks[i]["toxic"] is not None and remainder(i, 3) != 1]
    got = toxicity.learn_entries(spark.createDataFrame(rows, "_id long, _text string, y int"))
    want = plain_entries(rows)
    assert want and set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_toxicity_scores_from_plain_matches(some):
    """Every score again: matches by looking at each word's beginning, the logistic fit by rows."""
    docs, labels, texts, marks = some
    train = [(i, texts[i], marks[i]["toxic"]) for i in sorted(texts) if i in marks and marks[i]["toxic"] is not None and remainder(i, 3) != 1]
    entries = plain_entries(train)

    def found(text, exceptions=()):
        joined = " " + " ".join(toxicity.folded_words(text)) + " "
        spared = {p + k for e in exceptions for p in range(len(joined)) if joined.startswith(e, p) for k in range(len(e) - 1)}
        best = {}
        for p in (p for p, c in enumerate(joined) if c == " " and p not in spared):
            best[p] = max(((entries[e], e) for e in entries if joined.startswith(e, p)), default=(0.0, ""))
        return joined, {p: e for p, e in best.items() if e[1]}

    phrases = collections.defaultdict(lambda: [0, 0])
    for _, text, y in train:
        joined, places = found(text)
        mine = set()
        for p, (_, e) in places.items():
            if p:
                mine.add(joined[joined.rfind(" ", 0, p):p] + e)
            after = joined[p:].split(" ")  # "", the word, the word after, ...
            if len(after) > 3:
                mine.add(f" {after[1]} {after[2]} ")
        for m in mine:
            phrases[m][y] += 1
    exceptions = [m for m, (clean, toxic) in phrases.items() if clean >= 5 and clean >= 0.9 * (clean + toxic)]

    def inputs(text):
        weight, n = math.fsum(w for w, _ in found(text, exceptions)[1].values()), len(toxicity.folded_words(text))
        return [1.0, math.log1p(weight), math.log1p(100 * weight / (n + 20))]

    every = {i: inputs(t) for i, t in texts.items()}
    x = np.array([[1.0, *(math.floor(v * 8 + 0.5) / 8 for v in every[i][1:])] for i, _, _ in train])
    y = np.array([t for _, _, t in train], float)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    assert sorted(got) == sorted(texts)
    # the coefficients that the scores imply, by least squares on their log odds
    ids = sorted(texts)
    odds = np.array([math.log(got[i]["score"] / (1 - got[i]["score"])) for i in ids])
    a = np.array([every[i] for i in ids])
    beta, *_ = np.linalg.lstsq(a, odds, rcond=None)
    assert np.allclose(a @ beta, odds, atol=1e-6)
    # and they are where the penalised likelihood is level, or a coefficient is held at 0
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - np.array([0.01, 0.5, 0.5]) * beta
    assert beta[1] > -1e-6 and beta[2] > -1e-6
    assert all(abs(s) < 1e-4 or (k and abs(beta[k]) < 1e-6) for k, s in enumerate(slope))
    assert all(got[i]["held_out"] == (remainder(i, 3) == 1) and got[i]["predicted"] == (got[i]["score"] >= 0.7) for i in ids)
