"""Golden rows for operators with quirks (FIXTURES.md section 4) and the regression
targets of the flagship (SURVEY 7.1)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL

from stereoscope.functions import text as TX
from stereoscope.functions.keys import url_safe_md5_b64
from stereoscope.operators import coverage as CV
from stereoscope.operators import display as DP
from stereoscope.operators import metrics as M
from stereoscope.operators import pairs as PR
from stereoscope.operators import sampling as SM
from stereoscope.operators import scoring as SC
from stereoscope.operators import templates as TP
from stereoscope.plans import flagship as FL
from stereoscope.sources import bank as BK
from stereoscope.sources.specs import BiasSpec, spec_terms


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr).first()[0]


def test_mask_term_quirks(spark):
    m = lambda s, t: _one(spark, TX.mask_term(F.col("s"), F.col("t")), s=s, t=t)
    assert m("then he, said", "he") == "then [T] said."      # the comma is lost
    assert m("he he ran", "he") == "[T] [T] ran."
    assert m("his mother's car", "mother") == "his mother's car."
    assert m('"He left"', "he") == "[T] left."
    assert m("a  he ran", "he") == "a [T] ran."              # extra spaces collapse to one


def test_template_refs_positional(spark):
    df = spark.createDataFrame(
        [("p1", "he loves his math.", "she loves her math.", "he", "she", "math"),
         ("p2", "the man works hard.", "the woman works hard today.", "man", "woman", "hard")],
        "pair_id string, sentence string, alt_sentence string, grp_term_1 string, grp_term_2 string, att_term string")
    out = {r.pair_id: (r.template, r.refs) for r in
           TP.template_refs(df).select("pair_id", "template", TP.refs_text(F.col("grp_refs")).alias("refs")).collect()}
    assert out["p1"] == ("[T] loves [R] math.", "his/her")
    # unequal lengths zip to the shorter one: '.' meets 'today'
    assert out["p2"] == ("the [T] works hard [R]", "./today")


def test_template_rejects(spark):
    df = spark.createDataFrame([("p", "nothing at all.", "x.", "he", "she", "a")],
                               "pair_id string, sentence string, alt_sentence string, grp_term_1 string, "
                               "grp_term_2 string, att_term string")
    assert TP.template_rejects(df).count() == 1
    assert TP.template_refs(df).count() == 0


def _label_spec(spark):
    return spec_terms(spark, BiasSpec("s", ("a", "b"), ("c", "d"), ("x",), ("y",)))


def test_labels_sides(spark):
    st = _label_spec(spark)
    pairs = spark.createDataFrame(
        [("s", "1", "a", "c", "x"), ("s", "2", "c", "a", "x"), ("s", "3", "a", "c", "y"),
         ("s", "4", "c", "a", "y"), ("s", "5", "zz", "c", "x")],
        "spec string, pair_id string, grp_term_1 string, grp_term_2 string, att_term string")
    got = {r.pair_id: (r.label_1, r.label_2) for r in PR.pair_labels(pairs, st).collect()}
    assert got["1"] == ("stereotype", "anti-stereotype")
    assert got["2"] == ("anti-stereotype", "stereotype")
    assert got["3"] == ("anti-stereotype", "stereotype")
    assert got["4"] == ("stereotype", "anti-stereotype")   # attribute side 1, group term on side 1
    assert got["5"] == ("stereotype", "anti-stereotype")   # group term on no side: unchanged
    rej = {(r.pair_id, r.reason) for r in PR.pair_rejects(pairs, st).collect()}
    assert ("5", "group term 1 not in spec") in rej


def test_winner_tie(spark):
    lab = spark.createDataFrame([("p", "a", "b", "stereotype", "anti-stereotype")],
                                "pair_id string, grp_term_1 string, grp_term_2 string, label_1 string, label_2 string")
    sc = spark.createDataFrame([("p", "m", 0.5, 0.5)], "pair_id string, model string, r0 double, r1 double")
    r = SC.pair_winner(lab, sc).first()
    assert (r.top, r.bottom, r.stereotyped, r.top_term, r.bottom_term) == (1, 1, 0, "b", "b")


def test_attribute_gaps_and_pair_gaps(spark):
    st = spec_terms(spark, BiasSpec("s", ("a", "b"), ("c", "d"), ("x", "y"), ("z",)))
    rows = [("s", "a", "c", "x")] * 3 + [("s", "a", "c", "y")] + [("s", "a", "d", "x")]
    sents = spark.createDataFrame(rows, "spec string, grp_term_1 string, grp_term_2 string, att_term string")
    gaps = {r.att_term: (r.n, r.n_gap) for r in CV.attribute_gaps(sents, st).collect()}
    assert gaps == {"x": (4, 0), "y": (1, 3), "z": (0, 4)}
    pg = {(r.pair_key, r.att_term): (r.n, r.n_gap) for r in CV.pair_gaps(sents, st).collect()}
    # (a, x) saw keys a/c (permitted) and a/d (not permitted): only a/c is kept
    assert pg[("a/c", "x")] == (3, 0)
    # (a, y) saw one key: kept
    assert pg[("a/c", "y")] == (1, 1)
    # a cell with nothing adds (own key, att, 0)
    assert pg[("b/d", "z")] == (0, 2)
    assert ("a/d", "x") not in pg


def test_pair_gaps_single_unpermitted_key_is_kept(spark):
    st = spec_terms(spark, BiasSpec("s", ("a", "b"), ("c", "d"), ("x",), ("z",)))
    sents = spark.createDataFrame([("s", "a", "d", "x")], "spec string, grp_term_1 string, grp_term_2 string, att_term string")
    pg = {(r.pair_key, r.att_term): r.n for r in CV.pair_gaps(sents, st).collect()}
    assert pg[("a/d", "x")] == 1


def test_append_dedupe_old_wins(spark):
    old = spark.createDataFrame([("t", "s1", "old", "1")], "org_grp_term string, sentence string, gen_model string, seq string")
    new = spark.createDataFrame([("t", "s1", "new", "0"), ("t", "s2", "new", "1"), ("u", "s1", "new", "2")],
                                "org_grp_term string, sentence string, gen_model string, seq string")
    got = {(r.org_grp_term, r.sentence): r.gen_model for r in BK.append_dedupe(old, new).collect()}
    assert got == {("t", "s1"): "old", ("t", "s2"): "new", ("u", "s1"): "new"}


def test_spec_name_hash(spark):
    h = _one(spark, url_safe_md5_b64(F.col("s")), s="brotherfathersistermotherscienceart")
    assert h == "gkW6YoocKR83xeMg2KZEfg=="


def test_percent_half_even(spark):
    assert _one(spark, DP.percent(F.col("x").cast("double")), x="0.625") == "62"
    assert _one(spark, DP.percent(F.col("x").cast("double")), x="0.05") == " 5"


def test_template_scores_reference_rule(spark):
    scored = spark.createDataFrame(
        [("s", "m", "p", "x", "[T] x.", "a", "b", 1, "anti-stereotype", "stereotype", "b", "a", 0.3, 0.0)],
        "spec string, model string, pair_id string, att_term string, template string, grp_term_1 string, "
        "grp_term_2 string, stereotyped int, label_1 string, label_2 string, top_term string, bottom_term string, "
        "top_logit double, bottom_logit double")
    r = M.template_scores(scored).first()
    # the measured tool tests label_1, so its 'stereotyped_version' is the bottom term here
    assert (r.stereotyped_version, r.anti_stereotyped_version, r.stereotyped_term) == ("a", "b", "b")


def test_sample_with_replacement_for_small_groups(spark):
    scored = spark.createDataFrame([("s", "m", "x", "p1", 1)] + [("s", "m", "y", f"q{i}", 0) for i in range(5)],
                                   "spec string, model string, att_term string, pair_id string, stereotyped int")
    s = SM.sample_per_attribute(scored, n=2, reps=3, seed=7).collect()
    by = {}
    for r in s:
        by.setdefault((r.rep, r.att_term), []).append(r.pair_id)
    for rep in range(3):
        assert by[(rep, "x")] == ["p1", "p1"]
        assert len(set(by[(rep, "y")])) == 2


def test_flagship_regression_sf0001(spark):
    got = {r.att_term: (r.n_pairs, r.n_stereotyped, r.n_ties) for r in FL.flagship(spark, SF_SMALL).collect()}
    assert got == {"for": (181, 67, 0), "from": (120, 67, 0), "was": (181, 81, 0), "with": (163, 99, 1)}
    assert FL.flagship(spark, SF_SMALL).first().model_bias == 0.4958


def test_same_result_under_partition_counts(spark):
    base = sorted(tuple(r) for r in FL.flagship(spark, SF_SMALL).collect())
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted(tuple(r) for r in FL.flagship(spark, SF_SMALL).collect()) == base
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_frequent_words_change_no_score(spark, monkeypatch):
    """Lookups by broadcast, by shuffle, or by both give the same losses and logits."""
    from stereoscope.operators import lm as LM
    from stereoscope.operators import scoring as SC
    lm = LM.train(FL.lm_corpus(spark, SF_SMALL))
    lp = FL.labelled_pairs(spark, SF_SMALL)
    got = []
    for frequent, whole in ((0, 1 << 40), (0, -1), (50, -1), (10**9, -1)):  # the whole table by broadcast, then parts of it
        monkeypatch.setattr(LM, "FREQUENT", frequent)
        monkeypatch.setattr(LM, "SMALL_TABLE_BYTES", whole)
        got.append((sorted(tuple(r) for r in SC.lm_causal_scores(lp, lm).collect()),
                    sorted(tuple(r) for r in SC.masked_scores(SC.lm_token_logits(lp, lm)).collect())))
    assert all(g == got[0] for g in got)


def test_masked_target_is_the_whole_term(spark):
    """The first place of all the target's words counts, not that of its first word."""
    import math

    from stereoscope.operators import lm as LM
    text = "the old house and the old man sat"
    counts = LM.train_bigrams(spark.createDataFrame([(text,)], "sentence string"))
    v = spark.createDataFrame([("p", text, "old man")], "pair_id string, text string, target string")
    got = {r.subtok_pos: r.logit for r in LM.masked_token_scores(v, counts, ["pair_id"]).collect()}
    size = counts.select("w2").distinct().count()
    lp = lambda c, h: math.log((c + 1) / (h + size))
    assert abs(got[0] - (lp(2, 2) + lp(1, 2))) < 1e-9     # the old, old man
    assert abs(got[1] - (lp(1, 2) + lp(1, 1))) < 1e-9     # old man, man sat


def test_pair_ids_are_unique(spark):
    for spec in (FL.fixture_spec().lower(), FL.repeated_spec()):
        lp = FL.labelled_pairs(spark, SF_SMALL, spec)
        assert lp.select("pair_id").distinct().count() == lp.count() > 0


def test_language_is_a_parameter(spark):
    """Every row is read unless a language is named."""
    from stereoscope.operators import mining as MI
    from stereoscope.sources import tables as TB
    docs, st = TB.documents(spark, "/root/testdata/sf0.01"), FL.spec_table(spark)
    assert MI.mine_sentences(MI.split_sentences(docs, lang="en"), st).count() == 2922
    assert MI.mine_sentences(MI.split_sentences(docs), st).count() == 2927


def test_supplied_rewrites_win(spark):
    from stereoscope.operators import mining as MI
    st = spec_terms(spark, BiasSpec("s", ("he",), ("she",), ("kind",), ("mean",)))
    s = spark.createDataFrame([(1, 0, "He said his dog is kind."), (2, 0, "Is she mean.")], "doc_id long, sent_pos int, sentence string")
    mined = MI.mine_sentences(s, st)
    alt = lambda **how: {r.doc_id: r.alt_sentence for r in MI.counterfactual_pairs(mined, st, **how).collect()}
    assert alt() == {1: "she said his dog is kind.", 2: "Is he mean."}
    assert alt(ref_words={"his": "her", "her": "his"}) == {1: "she said her dog is kind.", 2: "Is he mean."}
    first = MI.counterfactual_pairs(mined, st).where("doc_id = 1").select("pair_id", F.lit("She said her dog is kind.").alias("alt_sentence"))
    assert alt(rewrites=first) == {1: "She said her dog is kind.", 2: "Is he mean."}


def test_short_groups_are_sampled_whole(spark, monkeypatch):
    """Where the first cut leaves too few rows, the whole group is ranked: the same sample."""
    scored = spark.createDataFrame([("s", "m", "x", f"p{i}", i % 2) for i in range(40)], "spec string, model string, att_term string, pair_id string, stereotyped int")
    key = lambda: sorted(tuple(r) for r in SM.sample_per_attribute(scored, n=3, reps=5, seed=2).select("rep", "pair_id", "draw").collect())
    want = key()
    for enough in (0, 0.5, 1000):
        monkeypatch.setattr(SM, "ENOUGH", enough)
        assert key() == want


def test_checkpoint_folder_must_be_shared(spark, monkeypatch):
    import pytest

    from stereoscope import session
    conf = {"spark.master": "spark://host:7077"}

    class Conf:
        def get(self, k, default=None):
            return conf.get(k, default)

    class Session:
        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return None
    Session.conf = Conf()
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_predict_is_made_on_the_worker(spark):
    from stereoscope.operators import scoring as SC
    pairs = spark.createDataFrame([("p", "aa bb", "aa", "aa", "bb")], "pair_id string, sentence string, alt_sentence string, grp_term_1 string, grp_term_2 string")

    def make():
        return lambda texts, targets: [float(len(t)) for t in texts]

    got = {r.variant: r.loss for r in SC.batch_inference_scores(pairs, make_predict=make, model="m").collect()}
    assert got == {0: 5.0, 1: 2.0}


def test_bootstrap_units_are_spec_attributes(spark):
    st = spec_terms(spark, BiasSpec("s", ("a",), ("b",), ("bedside manner", "x"), ("y",)))
    rows = ([("s", "m", "bedside-manner", f"p{i}", 1) for i in range(3)] + [("s", "m", "x", "q", 0)]
            + [("s", "m", "zz", "r", 1)])
    scored = spark.createDataFrame(rows, "spec string, model string, att_term string, pair_id string, stereotyped int")
    mapped = {r.att_term for r in SM.spec_attribute_rows(scored, st).collect()}
    assert mapped == {"bedside manner", "x"}          # dashed fallback; an unknown spelling drops out
    b = SM.bootstrap_score(scored, reps=4, n=2, seed=1, spec_terms=st).first()
    assert b.n_reps == 4 and b.mean == 0.5            # (1 + 0) / 2 in every repeat
