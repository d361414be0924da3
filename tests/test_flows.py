"""The three user flows end to end on the small tables."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL

from stereoscope.operators import generation as GN
from stereoscope.plans import flagship as FL
from stereoscope.plans import flows as FW
from stereoscope.sources import bank as BK
from stereoscope.sources import tables as TB


def test_generate_retrieve_test(spark):
    spec = FL.fixture_spec().lower()
    out = tempfile.mkdtemp(prefix="stereoscope-flows-")
    gen = FW.generate_flow(spark, TB.documents(spark, SF_SMALL), spec, per_attribute=5, out=out + "/gen")
    recs = gen["records"]
    assert recs.count() == 20                       # 5 per attribute, 4 attributes
    assert set(os.listdir(out + "/gen")) >= {"targets", "records", "prompts", "rewrite_prompts", "rejects"}

    bank_path = out + "/bank"
    BK.write_bank(recs.withColumn("gen_model", F.lit("gpt-4")).select(*BK.BANK_COLUMNS), bank_path)
    ret = FW.retrieve_flow(spark, BK.read_bank(spark, bank_path), spec)
    assert ret["test_sentences"].count() == 20
    assert ret["coverage"].first().n_covered == 4

    sents = ret["test_sentences"].select("sentence", "alt_sentence", "grp_term_1", "grp_term_2", "att_term")
    res = FW.test_model_flow(spark, sents, spec, FW.corpus_sentences(spark, SF_SMALL),
                             models=("bigram-lm", "bigram-lm-masked"), bootstrap_reps=5, out=out + "/test")
    summary = {r.model: r.num_templates for r in res["run_summary"].collect()}
    assert summary == {"bigram-lm": 20, "bigram-lm-masked": 20}
    assert {r.model: (r.n_untestable, r.n_pairs) for r in res["untestable"].collect()} == {"bigram-lm": (0, 20), "bigram-lm-masked": (0, 20)}
    assert res["rejects"].count() == 0
    assert res["interpretation"].count() == 2
    assert os.path.isdir(out + "/test/display_pairs")


def test_model_flow_with_score_tables(spark):
    """Precomputed score tables (the contract for outside models) give the same verdicts as
    the built-in LM path."""
    from stereoscope.operators import scoring as SC
    from stereoscope.operators.lm import train
    spec = FL.fixture_spec().lower()
    lp = FL.labelled_pairs(spark, SF_SMALL)
    sents = lp.select("pair_id", "sentence", "alt_sentence", "grp_term_1", "grp_term_2", "att_term")
    corpus = FW.corpus_sentences(spark, SF_SMALL)
    vs = SC.lm_variant_scores(lp, train(corpus), model="gpt2")
    a = FW.test_model_flow(spark, sents, spec, corpus, models=("gpt2",), variant_scores=vs, bootstrap_reps=3)
    b = FW.test_model_flow(spark, sents, spec, corpus, bootstrap_reps=3)  # the default model
    key = lambda df: sorted((r.pair_id, r.stereotyped) for r in df.select("pair_id", "stereotyped").collect())  # noqa
    assert key(a["scored_pairs"]) == key(b["scored_pairs"])
    assert a["run_summary"].first().model_bias == b["run_summary"].first().model_bias


def test_named_models_need_their_scores(spark):
    """Nothing is reported under the name of a model that did not run."""
    import pytest
    spec = FL.fixture_spec().lower()
    sents = FL.labelled_pairs(spark, SF_SMALL).select("sentence", "alt_sentence", "grp_term_1", "grp_term_2", "att_term").limit(5)
    corpus = FW.corpus_sentences(spark, SF_SMALL)
    other = spark.createDataFrame([("p", 0, "gpt2-large", 1.0)], "pair_id string, variant int, model string, loss double")
    for models, tables in ((("gpt2",), {}), (("gpt2",), {"variant_scores": other}), (("bert-base-uncased",), {"variant_scores": other}), (("unheard-of",), {}), ((), {})):
        with pytest.raises(ValueError):
            FW.test_model_flow(spark, sents, spec, corpus, models=models, **tables)


def test_rejects_and_untestable_pairs(spark):
    spec = FL.fixture_spec().lower()
    rows = [("p1", "He is for it.", "This is for it.", "he", "this", "for"), ("p2", "He is by it.", "This is by it.", "he", "this", "by"),
            ("p3", "Nobody for now.", "Nobody for now.", "he", "this", "for")]
    sents = spark.createDataFrame(rows, "pair_id string, sentence string, alt_sentence string, grp_term_1 string, grp_term_2 string, att_term string")
    vs = spark.createDataFrame([("p1", 0, "gpt2", 1.0)], "pair_id string, variant int, model string, loss double")
    res = FW.test_model_flow(spark, sents, spec, FW.corpus_sentences(spark, SF_SMALL), models=("gpt2",), variant_scores=vs, bootstrap_reps=2)
    assert {(r.pair_id, r.reason) for r in res["rejects"].collect()} == {("p2", "attribute not in spec"), ("p3", "missing either group term in sentence")}
    assert [(r.n_untestable, r.n_pairs) for r in res["untestable"].collect()] == [(1, 1)]


def test_reports_of_the_test_flow(spark):
    """Tiles, counts, the run's record and the exported files of a run with two models; equal rows are told apart."""
    import pandas as pd
    spec = FL.fixture_spec().lower()
    out = tempfile.mkdtemp(prefix="stereoscope-flows-")
    lp = FL.labelled_pairs(spark, SF_SMALL).select("sentence", "alt_sentence", "grp_term_1", "grp_term_2", "att_term").orderBy("sentence").limit(40).coalesce(1)
    sents = lp.unionByName(lp.limit(3))
    res = FW.test_model_flow(spark, sents, spec, FW.corpus_sentences(spark, SF_SMALL), models=("bigram-lm", "bigram-lm-masked"), bootstrap_reps=2, out=out)
    assert sum(r.n for r in res["attribute_counts"].collect()) == 43
    assert {r.name for r in res["test_results"].collect()} == {r.bias_name for r in GN.spec_names(FL.spec_table(spark)).collect()}
    assert {r.tested_results.tested_model for r in res["test_results"].collect()} == {"bigram-lm", "bigram-lm-masked"}
    scored = res["scored_pairs"].groupBy("model").count().collect()
    assert {r["count"] for r in scored} == {43} and res["scored_pairs"].select("pair_id").distinct().count() == 43
    tiles = res["tiles"].toPandas()
    assert len(tiles) == 86
    for _, t in tiles.groupby(["model", "att_term"]):
        assert sorted(t.tile_no) == list(range(1, len(t) + 1))
    files = sorted(f for f in os.listdir(out + "/csv") if f.endswith(".csv") and f[0] != ".")
    assert len(files) == 2 and files[0].endswith("_bigram-lm-masked.csv") and files[1].endswith("_bigram-lm.csv")
    export = res["export"].toPandas()
    for f in files:
        back = pd.read_csv(f"{out}/csv/{f}", index_col=0, keep_default_na=False)
        want = export[export.file_name == f].sort_values("row_id")
        assert back.values.tolist() == want[back.columns].values.tolist() and back.index.tolist() == list(range(43))


def test_generate_flow_with_gaps_existing_and_rewrites(spark):
    """A retrieval's gaps and sentences go into the generation; reference words and supplied rewrites take effect; the corpus fills the targets."""
    from stereoscope.operators import mining as MI
    from stereoscope.sources import specs as S
    spec = FL.fixture_spec().lower()
    docs = TB.documents(spark, SF_SMALL)
    existing = spark.createDataFrame([("He is for it.", "This is for it.", "he", "this", "for")] * 3, "sentence string, alt_sentence string, grp_term_1 string, grp_term_2 string, att_term string")
    st = FL.spec_table(spark)
    from stereoscope.operators import coverage as CV
    gaps = CV.attribute_gaps(existing.withColumn("spec", F.lit(spec.name)), st)
    pairs = MI.counterfactual_pairs(FL.mined(spark, SF_SMALL), st)
    given = pairs.select("pair_id", F.lit("Given.").alias("alt_sentence"))
    answers = MI.corpus_answers(FW.corpus_sentences(spark, SF_SMALL), S.spec_terms(spark, spec))
    gen = FW.generate_flow(spark, docs, spec, gaps=gaps, existing=existing, rewrites=given, answers=answers)
    assert {r.att_term: r.n_target for r in gen["targets"].collect()} == {"for": 0, "was": 3, "with": 3, "from": 3}
    both = gen["test_sentences"].collect()
    assert len(both) == 12 and sum(r.alt_sentence == "Given." for r in both) == 9
    assert {r.att_term: (r.n, r.n_gap) for r in gen["attribute_gaps"].collect()} == {a: (3, 0) for a in ("for", "was", "with", "from")}
    cover = gen["coverage"].first()
    assert (cover.n_sentences, cover.n_covered, cover.gap_total) == (12, 4, 0) and cover.message.startswith("**Generated 12")
    report = {r.att_term: r for r in gen["fill_report"].collect()}
    assert set(report) == {"for", "was", "with", "from"} and report["for"].n_requests == 0
    assert gen["generated"].count() == sum(r.n_accepted for r in report.values()) > 0
    for r in gen["generated"].collect():
        assert f"{r.grp_term} " in r.sentence.lower() or f"{r.grp_term}," in r.sentence.lower() or f"{r.grp_term}." in r.sentence.lower()
    swapped = FW.generate_flow(spark, docs, spec, per_attribute=2, ref_words=FL.REF_WORDS)
    plain = FW.generate_flow(spark, docs, spec, per_attribute=2)
    key = lambda g: sorted(r.alt_sentence for r in g["test_sentences"].collect())
    assert len(key(swapped)) == len(key(plain)) == 8 and key(swapped) != key(plain)


def test_fill_asks_as_round_by_round_would(spark):
    """The report equals a plain loop's, for any tries asked ahead; what was not answered counts as a try."""
    import hashlib
    from stereoscope.operators import generation as GN
    from stereoscope.sources import specs as S
    spec = S.BiasSpec("s", ("he", "it"), ("she", "they"), ("tall", "kind"), ("rich", "calm"))
    st = S.spec_terms(spark, spec)
    wanted = {"tall": 0, "kind": 1, "rich": 4, "calm": 9}
    targets = spark.createDataFrame([("s", a, n) for a, n in wanted.items()], "spec string, att_term string, n_target long")
    luck = {"kind": 0.9, "rich": 0.25, "calm": 0.03}

    def good(att, request, t):
        return int(hashlib.md5(f"{att}|{request}|{t}".encode()).hexdigest()[:8], 16) / (1 << 32) < luck[att]

    def answers(requests):
        rows = [(*(r[c] for c in requests.columns), f"{r.grp_term} is {r.att_term}." if good(r.att_term, r.request, r["try"]) else "Nothing.")
                for r in requests.collect() if r.request % 7]  # some requests get no answer at all
        return spark.createDataFrame(rows, requests.schema.add("sentence", "string"))

    want = {}
    for att, n in wanted.items():
        got = asked = tried = 0
        while got < n and asked < 5 * n:
            for _ in range(2):
                hit = next((t for t in range(10) if asked % 7 and good(att, asked, t)), None)
                tried += 10 if hit is None else hit + 1
                got += hit is not None
                asked += 1
        want[att] = (n, asked, tried, min(got, n), max(n - got, 0))
    for ahead in (1, 4, 10):
        out = GN.fill_to_targets(targets, st, answers, ahead=ahead)
        assert {r.att_term: tuple(r[2:]) for r in out["report"].collect()} == want
        assert {a: n for a, n in out["sentences"].groupBy("att_term").count().collect()} == {a: w[3] for a, w in want.items() if w[3]}


def test_a_model_is_loaded_once_per_worker(spark):
    from stereoscope.operators import scoring as SC
    folder = tempfile.mkdtemp(prefix="stereoscope-loads-")
    pairs = spark.range(4000).repartition(40).selectExpr("cast(id as string) as pair_id", "'aa bb' as sentence", "'aa' as alt_sentence", "'aa' as grp_term_1", "'bb' as grp_term_2")

    def make():
        import os
        import uuid
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts, targets: [float(len(t)) for t in texts]

    out = SC.batch_inference_scores(pairs, make_predict=make, model="m")
    assert out.agg(F.sum("loss"), F.count(F.lit(1))).first()[:] == (4000 * 7.0, 8000)
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert 0 < len(loads) == len(set(loads)) <= 8
