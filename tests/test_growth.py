"""Work that must not be done twice or in one task: what the queries over larger tables rest on."""

import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from stereoscope.functions import patterns as PT
from stereoscope.operators import lm as LM
from stereoscope.operators import mining as MI
from stereoscope.operators import scoring as SC
from stereoscope.operators.ordinals import ordinal_within
from stereoscope.plans import flagship as FL
from stereoscope.sources import bank as BK

ODD = [None, "", "...", "A b a B a b.", "It's 4 o'clock; it's late", "İstanbul aİb ΣΑΣ K", "a\nb a", "naïve x-ray  x", "one"]


def plain_bigrams(texts):
    out = {}
    for t in texts:
        words = ["<s>", *[w for w in re.split("[^a-z]+", t or "") if w]]
        for b in zip(words, words[1:]):
            out[b] = out.get(b, 0) + 1
    return out


@pytest.mark.parametrize("gathered", [1, 1 << 20])
def test_bigram_counts_are_those_of_a_plain_count(spark, monkeypatch, gathered):
    monkeypatch.setattr(LM, "GATHERED_BYTES", gathered)
    df = spark.createDataFrame([(t,) for t in ODD * 3], "sentence string").repartition(2)
    lower = [r[0] for r in df.select(F.lower("sentence")).collect()]
    want = plain_bigrams(lower)
    assert {(r.w1, r.w2): r.c12 for r in LM.train_bigrams(df).collect()} == want
    lm = LM.train(df)
    hist = {}
    for (a, _), c in want.items():
        hist[a] = hist.get(a, 0) + c
    assert {r.w1: r.c1 for r in lm.hist.collect()} == hist
    assert (lm.v, lm.total) == (len({b for _, b in want}), sum(want.values()))


@pytest.mark.parametrize("gathered", [1, 40, 1 << 20])
def test_texts_are_counted_as_their_sentences(spark, monkeypatch, gathered):
    """The training reads a document as one row; it cuts where ``split_sentences`` does."""
    monkeypatch.setattr(LM, "GATHERED_BYTES", gathered)
    texts = [*ODD, "He sat.It is!a\nb a..  .? one", "a. ", " . ", "ends", "it", "x.y\u00a0z?\u0130t. K k", "\n\n", "a\rb.c;d!", "\u0000he.\u0000"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string").repartition(2)
    want = {(r.w1, r.w2): r.c12 for r in LM.train_bigrams(MI.split_sentences(docs)).collect()}
    assert set(PT.SENTENCE_SPLIT.replace("\\n", "\n")) - set("[]+") == set(PT.SENTENCE_ENDS)
    assert want and {(r.w1, r.w2): r.c12 for r in LM.train_bigrams(docs, "text", PT.SENTENCE_ENDS).collect()} == want
    units = LM.pair_units(spark.createDataFrame([("p", "he sat.", "it is")], "pair_id string, sentence string, alt_sentence string"))
    lm, split = LM.train(docs, "text", units=units, ends=PT.SENTENCE_ENDS), LM.train(MI.split_sentences(docs), units=units)
    assert (lm.v, lm.total) == (split.v, split.total)
    for x in ("bigrams", "hist", "asked"):
        assert sorted(map(tuple, getattr(lm, x).collect())) == sorted(map(tuple, getattr(split, x).collect()))


def test_the_corpus_is_trained_on_by_documents(spark, monkeypatch):
    read = []
    monkeypatch.setattr(FL, "train", lambda df, *a, **k: read.append(df.count()))
    FL.language_model(spark, SF_SMALL)
    assert read == [spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()]


def test_a_sentence_is_scored_once_for_its_attributes(spark):
    """Pairs of the same two texts are one unit; a bigram in the same place of both texts is one row."""
    rows = [("p", "he sat for a day.", "this sat for a day."), ("q", "he sat for a day.", "this sat for a day."), ("r", "it is.", "it really is."),
            ("s", "12", "one"), ("t", None, "one two"), ("u", "", "")]
    pairs = spark.createDataFrame(rows, "pair_id string, sentence string, alt_sentence string").coalesce(1)
    units = LM.pair_units(pairs)
    assert units.count() == 5 and units.select(F.explode("pair_ids")).count() == 6
    got = LM.unit_bigrams(units.where(F.array_contains(F.transform("pair_ids", lambda p: p["pair_id"]), "p")))
    assert got.count() == 7  # three that are the same, two by two that are not
    corpus = spark.createDataFrame([("he sat for a day",), ("it is one two",)], "sentence string")
    long = SC.variant_rows(pairs.withColumn("grp_term_1", F.lit("")).withColumn("grp_term_2", F.lit("")))
    want = sorted(tuple(r) for r in LM.sentence_loss(long, LM.train(corpus), ["pair_id", "variant"]).collect())
    for scored, lm in ((pairs, LM.train(corpus)), (units, LM.train(corpus, units=units))):
        got = SC.lm_variant_scores(scored, lm).select("pair_id", "variant", "loss")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_training_keeps_the_counts_that_scoring_reads(spark, monkeypatch):
    """All bigrams are counted; of the counts, those of the named units and the histories are written, not the corpus's."""
    from stereoscope import session
    made = []
    monkeypatch.setattr(session, "materialize", lambda df: made.append(df.checkpoint(eager=True)) or made[-1])
    corpus = [f"he w{chr(97 + i)} so x{chr(97 + i)} it" for i in range(20)]
    units = spark.createDataFrame([(1, "he so", "so it")], "unit long, sentence string, alt_sentence string")
    lm = LM.train(spark.createDataFrame([(t,) for t in corpus], "sentence string"), units=units)
    want = plain_bigrams(corpus)
    asked = plain_bigrams(["he so", "so it"])
    assert {(r.w1, r.w2): r.c12 for r in lm.bigrams.collect()} == want
    assert {(r.w1, r.w2): r.c12 for r in lm.asked.collect()} == {b: want.get(b, 0) for b in asked}
    assert (lm.v, lm.total) == (len({b for _, b in want}), sum(want.values()))
    assert {(r.w1, r.w2) for r in made[0].where("w2 is not null").collect()} == set(asked)


def test_tasks_hand_on_the_bigrams_that_may_be_asked(spark):
    """Of the counted bigrams, those that no unit has are not shuffled; histories and asked counts are whole."""
    corpus = spark.createDataFrame([(f"he w{chr(97 + i // 26)}{chr(97 + i % 26)} so it",) for i in range(500)], "sentence string")
    wanted = spark.createDataFrame([("<s>", "he"), ("so", "it"), ("it", "he")], "w1 string, w2 string")
    rows = LM.partial_counts(corpus, "sentence", LM.asked_bits(wanted)).collect()
    got, hist = {}, {}
    for r in rows:
        into, key = (hist, r.w1) if r.w2 is None else (got, (r.w1, r.w2))
        into[key] = into.get(key, 0) + r.c12
    want = plain_bigrams([r.sentence for r in corpus.collect()])
    assert {b: got[b] for b in [("<s>", "he"), ("so", "it")]} == {("<s>", "he"): 500, ("so", "it"): 500}
    assert len(got) < 20 < len(want) and all(want[b] == c for b, c in got.items())
    assert hist == {w: sum(c for (a, _), c in want.items() if a == w) for w in {x for b in want for x in b}}


def test_masked_scores_are_those_of_the_whole_model(spark):
    rows = [("p", "he sat for a day.", "this sat for a day.", "he", "this"), ("q", "so he.", "so these two", "he", "these two"), ("r", None, "it", "it", "it")]
    pairs = spark.createDataFrame(rows, "pair_id string, sentence string, alt_sentence string, grp_term_1 string, grp_term_2 string")
    corpus = spark.createDataFrame([("he sat for a day",), ("so these are two",), ("it sat",)], "sentence string")
    score = lambda lm: sorted(tuple(r) for r in SC.lm_token_logits(pairs, lm).collect())
    want = score(LM.train(corpus))
    assert want and score(LM.train(corpus, units=LM.pair_units(pairs)).of_units()) == want


def test_pairs_with_one_id_are_one_pair(spark):
    rows = [("p", "he sat.", "this sat."), ("p", "it is a day.", "that is a day.")]
    pairs = spark.createDataFrame(rows, "pair_id string, sentence string, alt_sentence string")
    lm = LM.train(spark.createDataFrame([("he sat a day",), ("that is it",)], "sentence string"))
    long = SC.variant_rows(pairs.withColumn("grp_term_1", F.lit("")).withColumn("grp_term_2", F.lit("")))
    want = {r.variant: r.loss for r in LM.sentence_loss(long, lm, ["pair_id", "variant"]).collect()}
    got = LM.pair_losses(pairs, lm).collect()
    assert [(r.l0, r.l1) for r in got] == [(want[0], want[1])]


def test_mining_takes_few_sentences_apart(spark):
    """Words are not split in a filter, where Spark would split those of every sentence."""
    plan = FL.mined(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if re.match(r"[\s:+\-]*Filter ", x)]
    assert filters and not any("array_distinct" in x for x in filters)
    assert any("RLIKE" in x for x in filters)


def test_many_keys_are_found_without_a_pattern(spark, monkeypatch):
    want = sorted(tuple(r) for r in FL.mined(spark, SF_SMALL).collect())
    monkeypatch.setattr(MI, "PATTERN_KEYS", 0)
    assert want and sorted(tuple(r) for r in FL.mined(spark, SF_SMALL).collect()) == want


@pytest.mark.parametrize("keys", [["he", "kit", "x.y", "a-b"], ["h\u00e9", "i\u0307t", "he"], [""]])
def test_a_key_is_found_by_a_pattern_where_it_is_a_word(spark, keys):
    """The pattern finds each sentence that has the key among its words, whatever its case, and lower-cases none for ASCII keys."""
    texts = ["he", "He sat.", "the", "sHE", "a he, b", "a HE!", "so he", "he's", " he", "\u212aIT is", "kiT", "\u0130t", "\u0130T.", "it", "H\u00c9 x", "X.Y", "xzy", "A-B.", "\nhe", "he\n", "", ".", "he\u00a0x"]
    df = spark.createDataFrame([(t,) for t in texts], "sentence string")
    low = F.lower("sentence")
    want = {r[0] for r in df.where(low.rlike("(?:^| )(?:" + "|".join(map(re.escape, keys)) + ")(?:[ .,!]|$)")).collect()}
    may = df.where(MI._may_hold(F.col("sentence"), keys))
    assert want and {r[0] for r in may.collect()} == want
    assert ("lower(" in may._jdf.queryExecution().optimizedPlan().toString().lower()) == (not all(k.isascii() for k in keys))


def test_rows_are_made_once_for_their_ordinals(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").mapInArrow(rows, "g long, id long")
    got = ordinal_within(df, ["g"], ["id"]).collect()
    assert sorted((r.g, r.id, r.ordinal) for r in got) == sorted((i % 3, i, i // 3 + 1) for i in range(1000))
    assert made.value == 1000


def test_a_large_bank_file_is_split(spark, tmp_path):
    """A file whose records are lines is read by several tasks; one with line breaks in its fields is read whole and right."""
    text = 'he said, "this" \u0001 and, that'
    lines = ["sentence,att_term"] + [f'"{text} {i}"'.replace('"this"', '""this""') + f",t{i}" for i in range(500)]
    (tmp_path / "he.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = BK.read_bank_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 2
        assert sorted((r.sentence, r.att_term, r.org_grp_term) for r in df.collect()) == sorted((f"{text} {i}", f"t{i}", "he") for i in range(500))
        (tmp_path / "it.csv").write_text("\n".join([*lines, '"two\nlines","a ""b"""', 'x,5" wide']) + "\n", encoding="utf-8")
        (tmp_path / "that.csv").write_bytes(b'sentence,att_term\r\nab,"c"\r\n"d\re",f\r\n')
        got = {t: sorted((r.sentence, r.att_term) for r in BK.read_bank_csv(spark, str(tmp_path), [t]).collect()) for t in ("it", "that")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["it"] == sorted([*[(f"{text} {i}", f"t{i}") for i in range(500)], ("two\nlines", 'a "b"'), ("x", '5" wide')])
    assert got["that"] == [("ab", "c"), ("d\re", "f")]


@pytest.mark.parametrize("named", [False, True])
def test_masked_bigrams_are_those_around_the_first_whole_term(spark, named):
    texts = [*ODD, "he", "the he", "these two, these two!", "THESE, two he", "a a b a b", "so these two", "a", "he the these"]
    rows = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in texts for x in (None, "", "12", "he", "these two", "a b", "a", "İt", "two-these"))]
    variants = spark.createDataFrame([(i, 0, t, x) for i, t, x in rows], "pair_id int, variant int, text string, target string")
    low = {r.pair_id: ([w for w in re.split("[^a-z]+", r.t or "") if w], [w for w in re.split("[^a-z]+", r.x or "") if w])
           for r in variants.select("pair_id", F.lower("text").alias("t"), F.lower("target").alias("x")).collect()}
    want = []
    for i, (t, x) in low.items():
        at = next((k for k in range(len(t) - len(x) + 1) if t[k:k + len(x)] == x), None) if x else None
        around = ["<s>", *t, None]
        for k, w in enumerate(x if at is not None else ()):
            want.append((i, k, 0, around[at + k], w))
            if around[at + k + 2] is not None:
                want.append((i, k, 1, w, around[at + k + 2]))
    read = LM.masked_bigrams(variants, ["pair_id", "variant"])
    assert want and sorted(tuple(r) for r in read.drop("variant").collect()) == sorted(want)
    corpus = spark.createDataFrame([(t,) for t in texts], "sentence string")
    score = lambda v, lm: sorted(tuple(r) for r in LM.masked_token_scores(v, lm, ["pair_id", "variant"]).collect())
    assert score(read, LM.train(corpus, units=read)) == score(variants, LM.train(corpus)) != []


def test_masked_scoring_takes_a_text_apart_once(spark):
    """No place of a text is looked at by taking the text apart again, and no filter does so before the column of tokens."""
    pairs = spark.createDataFrame([("p", "he sat.", "this sat.", "he", "this")], "pair_id string, sentence string, alt_sentence string, grp_term_1 string, grp_term_2 string")
    plan = SC.masked_bigrams(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_replace") == 2  # the text and the term


def test_masked_training_asks_for_what_it_reads(spark, monkeypatch):
    """The bigrams around the terms are named to the training, not all of the pairs' texts."""
    named = []
    monkeypatch.setattr(FL, "train", lambda *a, **k: named.append(k["units"]) or LM.train(*a, **k))
    assert FL.masked_scored_pairs(spark, SF_SMALL, failsafe="coin").count() > 0
    assert [set(u.columns) for u in named] == [{"pair_id", "variant", "subtok_pos", "side", "w1", "w2"}]
