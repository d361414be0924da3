"""Command line: run a user flow over table folders.

  python -m stereoscope retrieve --bank DIR --spec SPEC.json [--paper-only] --out OUT
  python -m stereoscope generate --tables DIR --spec SPEC.json [--per-attribute 5 | --gaps PARQUET]
                                 [--existing PARQUET] [--ref-words JSON] [--rewrites PARQUET] [--fill] --out OUT
  python -m stereoscope test     --tables DIR --spec SPEC.json --sentences PARQUET
                                 [--models bigram-lm gpt2 ...] [--variant-scores PARQUET]
                                 [--token-logits PARQUET] --out OUT
  python -m stereoscope append   --bank DIR --records PARQUET

``--tables`` holds documents.parquet (the corpus); ``--bank`` is a stored sentence bank, or, with ``--csv``, a folder of
CSV files, one per group term. ``--gaps`` and ``--existing`` take a retrieve run's attribute_gaps and test_sentences;
``--fill`` asks the corpus for sentences until the targets are met. Models other
than the built-in bigram-lm and bigram-lm-masked need their score tables. On a cluster submit with spark-submit and
let the launcher's session settings apply (only unset keys are filled in).
"""

from __future__ import annotations

import argparse
import json

from stereoscope.operators import mining as MI
from stereoscope.plans import flows
from stereoscope.session import get_session
from stereoscope.sources import bank as BK
from stereoscope.sources import specs as S
from stereoscope.sources import tables as TB


def main(argv=None):
    ap = argparse.ArgumentParser(prog="stereoscope")
    sub = ap.add_subparsers(dest="cmd", required=True)
    g = sub.add_parser("generate", help="mine new test sentences for a spec from the corpus")
    t = sub.add_parser("test", help="score test sentences with models and write every report")
    r = sub.add_parser("retrieve", help="saved test sentences of a spec from the bank, with coverage and gaps")
    w = sub.add_parser("append", help="append generation records to the bank")
    for p in (g, t):
        p.add_argument("--tables", required=True)
    for p in (r, w):
        p.add_argument("--bank", required=True)
    w.add_argument("--records", required=True, help="parquet of records (e.g. a generate run's records)")
    r.add_argument("--paper-only", action="store_true")
    for p in (r, w):
        p.add_argument("--csv", action="store_true", help="the bank (retrieve) or the records (append) are CSV files, one per group term")
    for p in (g, t, r):
        p.add_argument("--spec", required=True, help="spec JSON file")
        p.add_argument("--out", required=True)
        p.add_argument("--seed", type=int, default=0)
    g.add_argument("--per-attribute", type=int, default=5)
    g.add_argument("--gaps", help="parquet of attribute gaps (a retrieve run's attribute_gaps)")
    g.add_argument("--existing", help="parquet of test sentences that are there (a retrieve run's test_sentences)")
    g.add_argument("--ref-words", help="JSON file: reference word -> the word it is swapped with")
    g.add_argument("--rewrites", help="parquet of supplied rewrites (pair_id, alt_sentence)")
    g.add_argument("--fill", action="store_true", help="also ask the corpus, request by request, until the targets are met")
    t.add_argument("--sentences", required=True, help="parquet of test sentences (e.g. a generate run's records)")
    t.add_argument("--models", nargs="+", default=["bigram-lm"])
    t.add_argument("--variant-scores", help="parquet of causal models' losses")
    t.add_argument("--token-logits", help="parquet of masked models' logits")
    t.add_argument("--bootstrap-reps", type=int, default=30)
    a = ap.parse_args(argv)

    spark = get_session(app_name=f"stereoscope-{a.cmd}")
    if a.cmd == "append":
        BK.append_bank(spark, a.bank, BK.read_bank_csv(spark, a.records) if a.csv else spark.read.parquet(a.records))
        spark.stop()
        return
    with open(a.spec) as fh:
        spec = S.spec_from_json(json.load(fh))
    table = lambda path: spark.read.parquet(path) if path else None
    if a.cmd == "generate":
        words = None
        if a.ref_words:
            with open(a.ref_words) as fh:
                words = json.load(fh)
        answers = MI.corpus_answers(flows.corpus_sentences(spark, a.tables), S.spec_terms(spark, spec.lower()), a.seed) if a.fill else None
        flows.generate_flow(spark, TB.documents(spark, a.tables), spec, gaps=table(a.gaps), per_attribute=a.per_attribute, seed=a.seed,
                            out=a.out, existing=table(a.existing), ref_words=words, rewrites=table(a.rewrites), answers=answers)
    elif a.cmd == "retrieve":
        bank = BK.read_bank_csv(spark, a.bank) if a.csv else BK.read_bank(spark, a.bank)
        flows.retrieve_flow(spark, bank, spec, paper_only=a.paper_only, seed=a.seed, out=a.out)
    else:
        sents = spark.read.parquet(a.sentences)
        if "grp_term1" in sents.columns:  # a generation record: map to pair columns
            sents = sents.withColumnRenamed("grp_term1", "grp_term_1").withColumnRenamed("grp_term2", "grp_term_2")
        sents = sents.select("sentence", "alt_sentence", "grp_term_1", "grp_term_2", "att_term")
        flows.test_model_flow(spark, sents, spec.lower(), flows.corpus_sentences(spark, a.tables),
                              models=tuple(a.models), variant_scores=table(a.variant_scores),
                              token_logits=table(a.token_logits), bootstrap_reps=a.bootstrap_reps, seed=a.seed, out=a.out)
    spark.stop()


if __name__ == "__main__":
    main()
