"""Flagship: mine -> counterfactual rewrite -> label -> bigram LM loss of both
variants -> winner -> per-attribute and overall Stereotype Score.

Answers: how often does the language model prefer the stereotyped variant,
per attribute and overall? The spec is a parameter; the work grows with the
corpus (``documents``).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoscope.functions import patterns as PT
from stereoscope.operators import metrics as M
from stereoscope.operators import mining as MI
from stereoscope.operators import pairs as PR
from stereoscope.operators import scoring as SC
from stereoscope.operators.lm import BigramLM, pair_units, train, train_bigrams
from stereoscope.session import materialize  # noqa: F401  (used by the plans through this module)
from stereoscope.sources import specs as S
from stereoscope.sources import tables as TB
from stereoscope.sources.bank import BANK_COLUMNS

LM_MODEL = "bigram-lm"


def retrieval_spec() -> S.BiasSpec:
    """A second spec over the same corpus, for retrieval and reject reports: it drops
    'was' and 'that' and adds 'is' and 'those', so some bank rows fall outside it."""
    return S.BiasSpec("fixture_retrieval", ("he", "it"), ("this", "those"), ("for", "is"), ("with", "from"))


def repeated_spec() -> S.BiasSpec:
    """A spec with a term on both sides: each place makes its own pairs."""
    return S.BiasSpec("fixture_repeated", ("he", "it"), ("it", "that"), ("for", "was"), ("with", "for"))


def long_spec() -> S.BiasSpec:
    """A spec with a list of more than 50 terms (two-letter words, some of them in the corpus)."""
    return S.BiasSpec("fixture_long", tuple(a + b for a in "theoains" for b in "aeionrst"), ("this", "that"), ("for", "was"), ("with", "from"))


# words that refer to a group term, swapped with it in the rewrite
REF_WORDS = {"of": "to", "to": "of", "the": "an", "an": "the"}


def spelled_spec() -> S.BiasSpec:
    """Attributes of two words, one with a dash."""
    return S.BiasSpec("fixture_spelled", ("he", "it"), ("this", "that"), ("of the", "to the"), ("in-the", "on the"))


def unbalanced_spec() -> S.BiasSpec:
    """A spec with lists of unequal length (3 vs 2), for list balancing."""
    return S.BiasSpec("fixture_unbalanced", ("he", "it", "she"), ("this", "that"), ("for", "was"),
                      ("with", "from", "by"))


def fixture_spec() -> S.BiasSpec:
    with open(os.path.join(S.REGISTRY_DIR, "fixture_corpus_words.json")) as fh:
        return S.spec_from_json(json.load(fh))


def spec_table(spark: SparkSession, spec: S.BiasSpec | None = None) -> DataFrame:
    """Terms are lower-cased before everything in the mining flow."""
    return S.spec_terms(spark, (spec or fixture_spec()).lower())


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MI.split_sentences(TB.documents(spark, sf_dir))


def lm_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM training text: every sentence."""
    return sentences(spark, sf_dir)


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_bigrams(lm_corpus(spark, sf_dir))


def language_model(spark: SparkSession, sf_dir: str, units: DataFrame | None = None) -> BigramLM:
    """Train the bigram LM on every sentence once per job (counts checkpointed); ``units``, which it will score, may be named to it.
    The training cuts the texts where ``split_sentences`` does, so a sentence is no row of its own (``lm_corpus``)."""
    return train(TB.documents(spark, sf_dir), "text", units=units, ends=PT.SENTENCE_ENDS)


def held_out_model(spark: SparkSession, sf_dir: str) -> BigramLM:
    """A model of other text than the documents that are scored: the conversations' sentences."""
    return train(TB.conversations(spark, sf_dir), "text", ends=PT.SENTENCE_ENDS)


def lm_variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of both variants of every labelled pair."""
    units = pair_units(labelled_pairs(spark, sf_dir))
    return SC.lm_variant_scores(units, language_model(spark, sf_dir, units), LM_MODEL)


def mined(spark: SparkSession, sf_dir: str, spec: S.BiasSpec | None = None) -> DataFrame:
    return MI.mine_sentences(sentences(spark, sf_dir), spec_table(spark, spec))


def labelled_pairs(spark: SparkSession, sf_dir: str, spec: S.BiasSpec | None = None) -> DataFrame:
    st = spec_table(spark, spec)
    pairs = MI.counterfactual_pairs(MI.mine_sentences(sentences(spark, sf_dir), st), st)
    return PR.pair_labels(pairs, st)


def scored_pairs(spark: SparkSession, sf_dir: str, spec: S.BiasSpec | None = None,
                 lm: BigramLM | None = None, lp: DataFrame | None = None, keep: bool = False,
                 units: DataFrame | None = None) -> DataFrame:
    """Labelled pairs (materialized: read by the scorer and by the winner join) scored by
    the causal LM. ``keep=True`` materializes the result for flows that read it again.
    ``units`` are those of ``lp`` that ``lm`` was trained with."""
    lp = lp if lp is not None else materialize(labelled_pairs(spark, sf_dir, spec))
    if units is None:
        units = pair_units(lp) if lm is None else lp
    scores = SC.lm_causal_scores(units, lm if lm is not None else language_model(spark, sf_dir, units), LM_MODEL)
    out = SC.pair_winner(lp, scores)
    return materialize(out) if keep else out


def masked_scored_pairs(spark: SparkSession, sf_dir: str, spec: S.BiasSpec | None = None,
                        failsafe: str = "exclude", lm: BigramLM | None = None,
                        lp: DataFrame | None = None) -> DataFrame:
    """Masked-form scoring (G2) by the bigram LM: logits of the target tokens at the first mask."""
    lp = lp if lp is not None else materialize(labelled_pairs(spark, sf_dir, spec))
    read = materialize(SC.masked_bigrams(lp))  # by the training and by the scores
    lm = lm if lm is not None else language_model(spark, sf_dir, read)
    scores = SC.masked_scores(SC.lm_token_logits(read, lm, LM_MODEL + "-masked"))
    return (SC.pair_winner(lp, scores, failsafe=failsafe)
            .withColumn("model", F.lit(LM_MODEL + "-masked")))


def scored_full(spark: SparkSession, sf_dir: str, spec: S.BiasSpec | None = None,
                scored: DataFrame | None = None) -> DataFrame:
    """Scored pairs with their template and reference marks (E4-E6) for result shaping."""
    from stereoscope.operators.templates import template_refs
    return template_refs(scored if scored is not None else scored_pairs(spark, sf_dir, spec))


def flagship(spark: SparkSession, sf_dir: str, spec: S.BiasSpec | None = None) -> DataFrame:
    """Per-attribute Stereotype Score with the overall (macro) score on every row."""
    from pyspark.sql import Window
    att = M.attribute_scores(scored_pairs(spark, sf_dir, spec))
    # the macro score over the (small) per-attribute table, without a second pass over the pairs
    overall = F.round(F.avg("score").over(Window.partitionBy("spec", "model")), 4)
    return att.withColumn("model_bias", overall)


# --------------------------------------------------------------- bank derived from the corpus
# FIXED VALUES: generator names and record types assigned to derived bank rows by doc_id.
BANK_GEN_MODELS = ("gpt-3.5-turbo", "gpt-4", "gpt-3.5", "text-davinci-003")
BANK_TYPES = ("tool", "paper", None)
# conversation turns get ids above every document id: a pairing of (conv_id, turn) that never repeats
CONV_ID_OFFSET = 1_000_000_000_000
CONV_ID = f"{CONV_ID_OFFSET} + (conv_id + turn) * (conv_id + turn + 1) div 2 + turn"


def generation_records(spark: SparkSession, pairs: DataFrame, spec: S.BiasSpec | None = None) -> DataFrame:
    """C11 records for labelled pairs: simple template (E3), alternative template and refs."""
    from stereoscope.functions.text import template_simple
    from stereoscope.operators.generation import generation_record
    from stereoscope.operators.templates import template_refs
    st = spec_table(spark, spec)
    p = (template_refs(pairs).withColumnRenamed("template", "alt_template")
         .withColumn("template", template_simple(F.col("sentence"), F.col("grp_term_1"), F.col("grp_term_2"))))
    return generation_record(p, st, keep=("doc_id",))


def derived_bank(spark: SparkSession, sf_dir: str, corpus: str = "documents") -> DataFrame:
    """The sentence bank as the measured tool stores it, derived from corpus mining:
    org_grp_term = mined term; gen_model and type assigned by the row's doc_id."""
    st = spec_table(spark)
    if corpus == "documents":
        sents = sentences(spark, sf_dir)
    else:
        conv = TB.conversations(spark, sf_dir).select(F.expr(CONV_ID).alias("doc_id"), "text")
        sents = MI.split_sentences(conv)
    pairs = PR.pair_labels(MI.counterfactual_pairs(MI.mine_sentences(sents, st), st), st)
    rec = generation_records(spark, pairs)
    models = F.array(*[F.lit(m) for m in BANK_GEN_MODELS])
    types = F.array(*[F.lit(t) for t in BANK_TYPES])
    return (rec
            .withColumn("gen_model", F.element_at(models, (F.pmod("doc_id", F.lit(len(BANK_GEN_MODELS))) + 1).cast("int")))
            .withColumn("type", F.element_at(types, (F.pmod("doc_id", F.lit(len(BANK_TYPES))) + 1).cast("int")))
            .select("pair_id", *BANK_COLUMNS))


def term_support(spark: SparkSession, sf_dir: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``terms`` plus n_sentences: corpus sentences holding the term (strict boundaries),
    counted with the mining key join (terms are spec-sized and size-checked)."""
    keyed = MI.term_keys(terms.select(F.lit("s").alias("spec"), F.lit("t").alias("axis"), F.lit(0).alias("side"),
                                      F.lit(0).alias("pos"), F.col(term_col).alias("term")).distinct())
    tk = S.bounded(keyed.select("key", "term", "simple", "accept_re"))
    hits = (MI.candidate_words(sentences(spark, sf_dir), [])
            .join(tk, "key")
            .where(F.col("simple") | F.expr("ls rlike accept_re"))
            .groupBy(F.col("term").alias(term_col)).agg(F.count(F.lit(1)).alias("n_sentences")))
    return (terms.join(hits, term_col, "left")
            .withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0)).cast("long")))
