"""Property tests (hypothesis)."""

import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stereoscope.functions import text as TX
from stereoscope.operators import coverage as CV
from stereoscope.operators import scoring as SC
from stereoscope.sources.specs import BiasSpec, spec_terms

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))


def loop_mask(sentence: str, term: str, mark: str = "[T]") -> str:
    """Plain restatement of the measured tool's find-and-splice loop (the property's reference)."""
    t = sentence.strip('"')
    if t and t[-1] not in string.punctuation:
        t += "."
    pat = f"(^|[ ]+){re.escape(term.lower())}[ .,!]+"
    m = re.search(pat, t.lower())
    while m:
        i1 = m.start() + (1 if t[m.start()] == " " else 0)
        t = t[:i1] + mark + t[m.end() - 1:]
        m = re.search(pat, t.lower())
    return t


words = st.sampled_from(["he", "He", "the", "she", "ran", "x", "he,", "he.", "he!", "'s", "  ", "", "here"])
sentences = st.lists(words, min_size=1, max_size=8).map(lambda ws: " ".join(ws))


@SETTINGS
@given(st.lists(sentences, min_size=1, max_size=20))
def test_mask_equals_loop(spark, batch):
    df = spark.createDataFrame([(s,) for s in batch], "s string")
    got = [r[0] for r in df.select(TX.mask_term(F.col("s"), F.lit("he"))).collect()]
    assert got == [loop_mask(s, "he") for s in batch]


@SETTINGS
@given(st.lists(st.sampled_from(["x", "y", "z", "w"]), min_size=1, max_size=30))
def test_attribute_gaps_nonnegative_min_zero(spark, atts):
    stt = spec_terms(spark, BiasSpec("s", ("a",), ("b",), ("x", "y"), ("z", "w")))
    rows = spark.createDataFrame([("s", "a", "b", a) for a in atts], "spec string, grp_term_1 string, grp_term_2 string, att_term string")
    gaps = [r.n_gap for r in CV.attribute_gaps(rows, stt).collect()]
    assert min(gaps) == 0 and all(g >= 0 for g in gaps)
    pg = CV.pair_gaps(rows, stt).collect()
    assert sum(r.n_gap for r in pg) == sum(max(0, 2 - r.n) for r in pg)


@SETTINGS
@given(st.lists(st.tuples(st.floats(0, 10, allow_nan=False), st.floats(0, 10, allow_nan=False),
                          st.booleans()), min_size=1, max_size=20))
def test_swapping_variants_keeps_verdict(spark, items):
    lab, lab_sw, sc, sc_sw = [], [], [], []
    for i, (r0, r1, s_first) in enumerate(items):
        if r0 == r1:
            continue
        l1, l2 = ("stereotype", "anti-stereotype") if s_first else ("anti-stereotype", "stereotype")
        lab.append((str(i), "a", "b", l1, l2))
        lab_sw.append((str(i), "b", "a", l2, l1))
        sc.append((str(i), "m", r0, r1))
        sc_sw.append((str(i), "m", r1, r0))
    if not lab:
        return
    ls = "pair_id string, grp_term_1 string, grp_term_2 string, label_1 string, label_2 string"
    ss = "pair_id string, model string, r0 double, r1 double"
    a = {r.pair_id: r.stereotyped for r in SC.pair_winner(spark.createDataFrame(lab, ls), spark.createDataFrame(sc, ss)).collect()}
    b = {r.pair_id: r.stereotyped for r in SC.pair_winner(spark.createDataFrame(lab_sw, ls), spark.createDataFrame(sc_sw, ss)).collect()}
    assert a == b


def test_model_score_in_unit_interval(spark):
    from conftest import SF_SMALL
    from stereoscope.operators import metrics as M
    from stereoscope.plans import flagship as FL
    r = M.model_score(FL.scored_pairs(spark, SF_SMALL)).first()
    assert 0.0 <= r.model_bias <= 1.0


MINING_TERMS_G = ("he", "big man", "st. louis", "x-ray")
MINING_TERMS_A = ("math", "high school", "dr.", "a!b")
vocab = st.sampled_from(["he", "He", "big", "man", "st.", "louis", "x-ray", "math", "Math,", "high", "school",
                         "dr.", "a!b", "the", "big  man", "he's", "st.louis", "x", "b", ",", "!", "."])


def brute_mine(sentence: str):
    low = sentence.lower()
    hit = lambda t: re.search(r"(^| )" + re.escape(t) + r"[ .,!]", low) is not None
    gs = [t for t in MINING_TERMS_G if hit(t)]
    ats = [t for t in MINING_TERMS_A if hit(t)]
    return {(g, a) for g in gs for a in ats}


@SETTINGS
@given(st.lists(st.lists(vocab, min_size=1, max_size=9).map(lambda ws: " ".join(ws) + "."), min_size=1, max_size=25))
def test_mining_equals_brute_force(spark, batch):
    from stereoscope.operators.mining import mine_sentences
    spec = BiasSpec("p", MINING_TERMS_G[:2], MINING_TERMS_G[2:], MINING_TERMS_A[:2], MINING_TERMS_A[2:])
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(batch)], "doc_id long, sent_pos int, sentence string")
    got = {(r.doc_id, r.grp_term, r.att_term) for r in mine_sentences(df, spec_terms(spark, spec)).collect()}
    want = {(i, g, a) for i, s in enumerate(batch) for g, a in brute_mine(s)}
    assert got == want


def loop_rewrite(sentence: str, term: str, partner: str) -> str:
    """Plain restatement of the rewrite rule: whole-word, case-insensitive, applied twice so
    adjacent repeats sharing one separator are both replaced."""
    pat = re.compile(r"(^| )" + re.escape(term) + r"([ .,!])", re.IGNORECASE)
    for _ in range(2):
        sentence = pat.sub(lambda m: m.group(1) + partner + m.group(2), sentence)
    return sentence


rw_words = st.sampled_from(["he", "He", "HE", "the", "he,", "he.", "he!", "he's", "she", "x", "he he", "  "])


@SETTINGS
@given(st.lists(st.lists(rw_words, min_size=1, max_size=8).map(lambda ws: " ".join(ws) + "."), min_size=1, max_size=20))
def test_rewrite_equals_restatement(spark, batch):
    from stereoscope.operators.mining import rewrite_term
    df = spark.createDataFrame([(s,) for s in batch], "s string")
    got = [r[0] for r in df.select(rewrite_term(F.col("s"), F.lit("he"), F.lit("it$1"))).collect()]
    assert got == [loop_rewrite(s, "he", "it$1") for s in batch]
