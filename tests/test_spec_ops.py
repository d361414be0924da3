"""Golden rows for spec and generation operators."""

from pyspark.sql import functions as F

from stereoscope.operators import coverage as CV
from stereoscope.operators import generation as GN
from stereoscope.operators import sampling as SM
from stereoscope.operators import spec_ops as SO
from stereoscope.sources.specs import BiasSpec, read_specs, spec_terms, specs_to_terms


def test_parse_term_text(spark):
    texts = spark.createDataFrame([("s", "group", 0, " a, B ,, c d ,a,\tx ")], "spec string, axis string, side int, text string")
    got = [r.term for r in SO.parse_term_text(texts).orderBy("pos").collect()]
    # spaces only are stripped (a tab stays), empties dropped, no lower-casing, no dedupe
    assert got == ["a", "B", "c d", "a", "\tx"]


def test_prefill_round_trip(spark):
    st = spec_terms(spark, BiasSpec("s", ("a b", "c"), ("d", "e"), ("x",), ("y",)))
    back = SO.parse_term_text(SO.prefill_text(st))
    assert sorted((r.axis, r.side, r.pos, r.term) for r in back.collect()) == \
        sorted((r.axis, r.side, r.pos, r.term) for r in st.collect())


def test_balance_lists(spark):
    st = spec_terms(spark, BiasSpec("s", ("a", "b", "c"), ("d", "e"), ("x",), ("y",)))
    bal = SM.balance_lists(st, seed=3).where(F.col("axis") == "group").collect()
    side0 = sorted((r.pos, r.term) for r in bal if r.side == 0)
    side1 = sorted((r.pos, r.term) for r in bal if r.side == 1)
    assert [p for p, _ in side0] == [0, 1] and {t for _, t in side0} <= {"a", "b", "c"}
    assert side1 == [(0, "d"), (1, "e")]
    # seeded: the same seed picks the same terms
    again = SM.balance_lists(st, seed=3).where((F.col("axis") == "group") & (F.col("side") == 0)).collect()
    assert sorted((r.pos, r.term) for r in again) == side0


def test_json_key_order_is_side(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"name": "n", "social_groups": {"zz": ["a"], "aa": ["b"], "mm": ["c"]},'
                 ' "attributes": {"q": ["x"], "b": ["y"]}}')
    t = specs_to_terms(read_specs(spark, str(p))).collect()
    sides = {(r.axis, r.side_name): r.side for r in t}
    assert sides[("group", "zz")] == 0 and sides[("group", "aa")] == 1
    assert ("group", "mm") not in sides          # a third list is ignored


def test_gen_targets_dash_fallback(spark):
    st = spec_terms(spark, BiasSpec("s", ("a",), ("b",), ("bedside manner", "x"), ("y",)))
    gaps = spark.createDataFrame([("s", 0, "bedside-manner", 3), ("s", 0, "x", 1)],
                                 "spec string, side int, att_term string, n_gap long")
    got = {r.att_term: r.n_target for r in GN.gen_targets(st, gaps).collect()}
    assert got == {"bedside manner": 3, "x": 1, "y": 0}


def test_gen_plan_request_cap(spark):
    st = spec_terms(spark, BiasSpec("s", ("a", "b"), ("c", "d"), ("x",), ("y",)))
    tg = spark.createDataFrame([("s", 0, 0, "x", 3), ("s", 1, 0, "y", 0)],
                               "spec string, side int, pos int, att_term string, n_target long")
    plan = GN.gen_plan(tg, st).collect()
    # rounds of two: 15 tries are passed by one
    assert len(plan) == 16 and {r.att_term for r in plan} == {"x"}
    assert GN.gen_plan(tg.withColumn("n_target", F.lit(1)).limit(1), st).count() == 6
    pairs = {("a", "c"), ("b", "d"), ("c", "a"), ("d", "b")}
    assert all((r.grp_term, r.partner) in pairs for r in plan)
    prompts = GN.gen_prompts(GN.gen_plan(tg, st), st).collect()
    assert all(r.instruction.startswith('Write a sentence including target term "') for r in prompts)
    assert all(r.instruction.count("'") <= 2 * 8 * 2 for r in prompts)


def test_own_pair_key_first_position_wins(spark):
    # 'a' is paired with 'c' at pos 0 and with 'd' at pos 1: its own key is the first one
    st = spec_terms(spark, BiasSpec("s", ("a", "a"), ("c", "d"), ("x",), ("y",)))
    own, permitted = CV._own_pair_keys(st)
    assert {r.term: r.own_key for r in own.collect()}["a"] == "a/c"
    assert {r.pair_key for r in permitted.collect()} == {"a/c", "a/d"}


def test_missing_partners(spark):
    from stereoscope.operators import mining as MI
    st = spec_terms(spark, BiasSpec("s", ("a", "b", "c"), ("d", "e"), ("x",), ("y",)))
    sents = spark.createDataFrame([(1, 0, "a x then."), (2, 0, "c x now."), (3, 0, "d x here.")],
                                  "doc_id long, sent_pos int, sentence string")
    mined = MI.mine_sentences(sents, st)
    assert {r.grp_term for r in mined.collect()} == {"a", "c", "d"}
    miss = MI.missing_partners(mined, st).collect()
    assert [(r.doc_id, r.grp_term) for r in miss] == [(2, "c")]
    pairs = {r.grp_term_1: r.grp_term_2 for r in MI.counterfactual_pairs(mined, st).collect()}
    assert pairs == {"a": "d", "d": "a"}
    assert {r.grp_term_1: r.alt_sentence for r in MI.counterfactual_pairs(mined, st).collect()}["a"] == "d x then."
