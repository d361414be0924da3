"""The measured tool's three user flows as single Spark jobs over tables.

retrieve_flow   saved sentences of a spec from the bank + coverage and gap reports
generate_flow   new test sentences for the gaps (corpus mining + rewrite) as generation records, with the existing ones' coverage
test_model_flow score the test sentences with one or more models and shape every report

Each flow materializes the intermediates that several reports read (labelled pairs,
scored pairs, the LM counts) once, then derives all outputs from them. Outputs are
returned as DataFrames and, with ``out``, written as parquet tables under that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.text import template_simple
from stereoscope.operators import coverage as CV
from stereoscope.operators import display as DP
from stereoscope.operators import generation as GN
from stereoscope.operators import metrics as M
from stereoscope.operators import mining as MI
from stereoscope.operators import pairs as PR
from stereoscope.operators import sampling as SM
from stereoscope.operators import scoring as SC
from stereoscope.operators import templates as TP
from stereoscope.operators.lm import train
from stereoscope.session import materialize
from stereoscope.sources import bank as BK
from stereoscope.sources import sinks as SK
from stereoscope.sources import specs as S
from stereoscope.sources import tables as TB


def _write(outputs: dict[str, DataFrame], out: str | None) -> dict[str, DataFrame]:
    if out:
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
    return outputs


def retrieve_flow(spark: SparkSession, bank: DataFrame, spec: S.BiasSpec, paper_only: bool = False,
                  seed: int = 0, out: str | None = None) -> dict[str, DataFrame]:
    """Flow 'get sentences': bank rows of the spec (C1, C2), then D1-D5. Like the measured
    tool, the lists are balanced (B3) first."""
    st = materialize(SM.balance_lists(S.spec_terms(spark, spec), seed))
    sents = materialize(BK.retrieve_pairs(bank, st, paper_only).withColumn("spec", F.lit(spec.name)))
    gaps = CV.attribute_gaps(sents, st)
    return _write({
        "test_sentences": sents,
        "attribute_counts": CV.attribute_counts(sents),
        "attribute_gaps": gaps,
        "pair_gaps": CV.pair_gaps(sents, st, only_missing=True),
        "coverage": CV.coverage_summary(sents, st),
    }, out)


SENTENCE_COLUMNS = ["sentence", "alt_sentence", "grp_term_1", "grp_term_2", "att_term"]


def generate_flow(spark: SparkSession, documents: DataFrame, spec: S.BiasSpec, gaps: DataFrame | None = None,
                  per_attribute: int = 5, seed: int = 0, out: str | None = None, existing: DataFrame | None = None,
                  ref_words: dict[str, str] | None = None, rewrites: DataFrame | None = None, answers=None) -> dict[str, DataFrame]:
    """Flow 'generate': targets (C5) from gaps or a constant, corpus mining (C9) with rewrite
    (C10), labels (F1), downsampling to the targets (C8), records (C11) and the prompt table (C6, C7)
    for any outside generator. Lists are balanced (B3) for planning and mining; labels use the
    full lists, as in the measured tool.

    ``gaps`` are a retrieval's ``attribute_gaps``. ``existing`` test sentences (``SENTENCE_COLUMNS``) are put before the new
    ones (C12); the coverage reports (D1-D3) are of both. ``ref_words`` are swapped along with the group term, ``rewrites``
    (pair_id, alt_sentence) win over the rewrite (C10). With ``answers``, an outside generator as ``GN.fill_to_targets`` asks it,
    its accepted sentences come as ``generated`` and what it was asked as ``fill_report``."""
    full = S.spec_terms(spark, spec.lower())
    st = materialize(SM.balance_lists(full, seed))
    targets = materialize(GN.gen_targets(st, gaps, per_attribute))
    mined = MI.mine_sentences(MI.split_sentences(documents), st)
    pairs = materialize(PR.pair_labels(MI.counterfactual_pairs(mined, st, ref_words, rewrites), full))
    chosen = materialize(GN.downsample_to_target(pairs, targets, seed))
    p = (TP.template_refs(chosen).withColumnRenamed("template", "alt_template")
         .withColumn("template", template_simple(F.col("sentence"), F.col("grp_term_1"), F.col("grp_term_2"))))
    plan = GN.gen_plan(targets, st, seed)
    new = chosen.select(*SENTENCE_COLUMNS)
    both = materialize((new if existing is None else BK.combine_sentences(existing.select(*SENTENCE_COLUMNS), new)).withColumn("spec", F.lit(spec.name)))
    outputs = {
        "targets": targets,
        "records": GN.generation_record(p, st),
        "prompts": GN.gen_prompts(plan, st, seed),
        "rewrite_prompts": GN.rewrite_prompts(chosen),
        "rejects": MI.missing_partners(mined, st),
        "test_sentences": both,
        "attribute_counts": CV.attribute_counts(both),
        "attribute_gaps": CV.attribute_gaps(both, st),
        "coverage": CV.coverage_summary(both, st, generated=True),
    }
    if answers is not None:
        filled = GN.fill_to_targets(targets, st, answers, seed)
        outputs |= {"generated": filled["sentences"], "fill_report": filled["report"]}
    return _write(outputs, out)


def _outside_scores(model: str, kind: str, variant_scores: DataFrame | None, token_logits: DataFrame | None) -> DataFrame:
    """Scores of a model that ran elsewhere, from its table."""
    if kind == "unscored":
        raise ValueError(f"model {model!r} is of no known family: name its kind by a known family, or use 'bigram-lm'")
    table = variant_scores if kind == "causal" else token_logits
    mine = None if table is None else table.where(F.col("model") == model)
    if mine is None or mine.isEmpty():
        raise ValueError(f"no scores of model {model!r}: give its rows in {'variant_scores' if kind == 'causal' else 'token_logits'}")
    return SC.causal_scores(mine) if kind == "causal" else SC.masked_scores(mine)


def test_model_flow(spark: SparkSession, sentences: DataFrame, spec: S.BiasSpec, corpus: DataFrame,
                    models=("bigram-lm",), variant_scores: DataFrame | None = None,
                    token_logits: DataFrame | None = None, bootstrap_reps: int = 30, seed: int = 0,
                    out: str | None = None) -> dict[str, DataFrame]:
    """Flow 'test model': templates (E4-E6), labels (F1), scores by model kind (G3), winner (G5), then
    H1-H13 and the bootstrap (H12).

    ``models`` names the models to report. The built-in 'bigram-lm' and 'bigram-lm-masked' are trained on
    ``corpus`` (column ``sentence``) here. Any other model must have its rows in ``variant_scores`` (causal)
    or ``token_logits`` (masked): a name without scores is an error, as nothing else may be reported under it.
    ``sentences``: (sentence, alt_sentence, grp_term_1, grp_term_2, att_term[, pair_id]); without ``pair_id`` a row's
    place names it, so equal rows are told apart. Output ``rejects``
    lists rows that fail a check (F1, F3, E4) with the reason; ``untestable`` counts pairs per model that
    lack a score (G4). ``export`` has the rows of the CSV files; with ``out`` these are written, one per spec and
    model, under ``out``/csv. ``test_results`` is the record of the run (A4)."""
    st = S.spec_terms(spark, spec)
    # the input order, by which tiles and exports are ordered
    s = sentences.drop("doc_id", "sent_pos").withColumn("spec", F.lit(spec.name)).withColumn("doc_id", F.monotonically_increasing_id()).withColumn("sent_pos", F.lit(0))
    if "pair_id" not in s.columns:
        s = s.withColumn("pair_id", F.md5(F.concat_ws("|", "spec", F.col("doc_id").cast("string"))))
    s = materialize(s)
    rejects = PR.pair_rejects(s, st).select("pair_id", "reason").unionByName(TP.template_rejects(s))
    labelled = materialize(TP.template_refs(PR.pair_labels(s, st)))
    if not models:
        raise ValueError("name at least one model")
    lm = None
    scored_parts, counted = [], []
    for row in SC.model_kind(spark.createDataFrame([(m,) for m in models], "model string")).collect():
        if row.model in dict(P.BUILT_IN_MODELS):
            lm = lm or train(corpus)
            sc = (SC.lm_causal_scores(labelled, lm, row.model) if row.kind == "causal"
                  else SC.masked_scores(SC.lm_token_logits(labelled, lm, row.model)))
        else:
            sc = _outside_scores(row.model, row.kind, variant_scores, token_logits)
        part = SC.pair_winner(labelled, sc, failsafe="keep")
        counted.append(part.groupBy("spec").agg(F.sum((~F.col("testable")).cast("long")).alias("n_untestable"),
                                                F.count(F.lit(1)).alias("n_pairs")).withColumn("model", F.lit(row.model)))
        scored_parts.append(part.where("testable"))
    scored, untestable = scored_parts[0], counted[0]
    for part, n in zip(scored_parts[1:], counted[1:]):
        scored, untestable = scored.unionByName(part), untestable.unionByName(n)
    scored = materialize(scored)
    att = M.attribute_scores(scored)
    ms = M.model_score(scored)
    n_sent = scored.groupBy("spec").agg(F.count_distinct("pair_id").alias("n_sentences"))
    shown = materialize(DP.display_pairs(scored, keep=("doc_id", "sent_pos")))
    names = GN.spec_names(st)
    export = materialize(SK.export_frame(shown, names, order=["doc_id", "sent_pos"], by_model=len(models) > 1))
    outputs = {
        "attribute_counts": CV.attribute_counts(s),
        "tiles": DP.tiles(shown, att, st),
        "test_results": SK.test_result_records(ms, names),
        "export": export,
        "rejects": rejects,
        "untestable": untestable,
        "scored_pairs": scored.drop("doc_id", "sent_pos").withColumn("grp_refs", TP.refs_text(F.col("grp_refs"))),
        "run_summary": M.run_summary(scored),
        "attribute_scores": att,
        "template_scores": M.template_scores(scored),
        "display_pairs": shown.drop("doc_id", "sent_pos").withColumn("grp_refs", TP.refs_text(F.col("grp_refs"))),
        "attribute_ranking": DP.attribute_ranking(att, st),
        "interpretation": DP.interpretation(att, ms, st, n_sent),
        "bootstrap": SM.bootstrap_score(scored, bootstrap_reps, seed=seed, spec_terms=st),
    }
    if out:
        SK.export_csv(export, f"{out.rstrip('/')}/csv")
    return _write(outputs, out)


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM training text for the flows: every sentence of the documents table."""
    return MI.split_sentences(TB.documents(spark, sf_dir))
