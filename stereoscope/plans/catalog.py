"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

All queries run over the whole ``documents`` table of ``sf_dir`` with the
fixture spec (words that occur in the driver corpus) as the parameter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoscope.functions import text as TX
from stereoscope.operators import coverage as CV
from stereoscope.operators import display as DP
from stereoscope.operators import generation as GN
from stereoscope.operators import pairs as PR
from stereoscope.operators import spec_ops as SO
from stereoscope.functions import patterns as PT
from stereoscope.sources import sinks as SK
from stereoscope.sources import specs as SP
from stereoscope.sources import bank as BK
from stereoscope.operators import sampling as SM
from stereoscope.operators import metrics as M
from stereoscope.operators import mining as MI
from stereoscope.operators import scoring as SC
from stereoscope.operators import templates as TP
from stereoscope.plans import flagship as FL
from stereoscope.plans import oracle as O
from stereoscope.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SPEC = FL.fixture_spec().lower()


# ---------------------------------------------------------------- flagship stages
@register("mine_sentences", O.with_ctes(SPEC, *O.pipeline(SPEC, "mined"), body="SELECT * FROM mined"))
def q_mine_sentences(spark, sf_dir):
    return FL.mined(spark, sf_dir)


@register("counterfactual_rewrite", O.with_ctes(SPEC, *O.pipeline(SPEC, "pairs"), body="""
SELECT spec, doc_id, sent_pos, pair_id, sentence, alt_sentence, grp_term_1, grp_term_2, att_term FROM pairs"""))
def q_counterfactual_rewrite(spark, sf_dir):
    st = FL.spec_table(spark)
    return (MI.counterfactual_pairs(FL.mined(spark, sf_dir), st)
            .select("spec", "doc_id", "sent_pos", "pair_id", "sentence", "alt_sentence",
                    "grp_term_1", "grp_term_2", "att_term"))


@register("pair_labels", O.with_ctes(SPEC, *O.pipeline(SPEC, "labelled"), body="""
SELECT pair_id, grp_term_1, grp_term_2, att_term, label_1, label_2 FROM labelled"""))
def q_pair_labels(spark, sf_dir):
    return FL.labelled_pairs(spark, sf_dir).select("pair_id", "grp_term_1", "grp_term_2", "att_term",
                                                   "label_1", "label_2")


@register("lm_bigrams", O.with_ctes(SPEC, O.LM, body="SELECT w1, w2, c12 FROM bigrams"))
def q_lm_bigrams(spark, sf_dir):
    return FL.bigrams(spark, sf_dir)


@register("lm_sentence_loss", O.with_ctes(SPEC, *O.pipeline(SPEC, "losses"), body="""
SELECT pair_id, variant, 'bigram-lm' AS model, loss FROM losses"""))
def q_lm_sentence_loss(spark, sf_dir):
    return FL.lm_variant_scores(spark, sf_dir)


@register("score_causal", O.with_ctes(SPEC, *O.pipeline(SPEC, "losses"), body="SELECT pair_id, model, r0, r1 FROM causal"))
def q_score_causal(spark, sf_dir):
    return SC.causal_scores(FL.lm_variant_scores(spark, sf_dir))


@register("pair_winner", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body="""
SELECT pair_id, model, stereotyped, top_term, bottom_term, top_logit, bottom_logit FROM scored"""))
def q_pair_winner(spark, sf_dir):
    return FL.scored_pairs(spark, sf_dir).select("pair_id", "model", "stereotyped", "top_term", "bottom_term",
                                                 "top_logit", "bottom_logit")


ATT_SCORES_SQL = """
SELECT spec, model, att_term, count(*) AS n_pairs, CAST(sum(stereotyped) AS BIGINT) AS n_stereotyped,
       CAST(sum(CAST(top_logit = bottom_logit AS INTEGER)) AS BIGINT) AS n_ties, round(avg(stereotyped), 6) AS score
FROM scored GROUP BY spec, model, att_term"""


@register("attribute_scores", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body=ATT_SCORES_SQL))
def q_attribute_scores(spark, sf_dir):
    return M.attribute_scores(FL.scored_pairs(spark, sf_dir))


@register("model_score", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body="""
SELECT spec, model, round(avg(s), 4) AS model_bias, CAST(sum(n) AS BIGINT) AS num_templates, count(*) AS n_attributes
FROM (SELECT spec, model, att_term, avg(stereotyped) AS s, count(*) AS n FROM scored GROUP BY spec, model, att_term)
GROUP BY spec, model"""))
def q_model_score(spark, sf_dir):
    return M.model_score(FL.scored_pairs(spark, sf_dir))


@register("stereotype_score", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body=f"""
SELECT a.*, o.model_bias FROM ({ATT_SCORES_SQL}) a
JOIN (SELECT spec, model, round(avg(score), 4) AS model_bias FROM ({ATT_SCORES_SQL}) GROUP BY spec, model) o
  ON a.spec = o.spec AND a.model = o.model"""))
def q_stereotype_score(spark, sf_dir):
    return FL.flagship(spark, sf_dir)


# ---------------------------------------------------------------- coverage and gaps
def _pairs(spark, sf_dir):
    return MI.counterfactual_pairs(FL.mined(spark, sf_dir), FL.spec_table(spark))


PAIRS_CTES = O.pipeline(SPEC, "pairs")


@register("attribute_counts", O.with_ctes(SPEC, *PAIRS_CTES, body="""
SELECT spec, att_term, count(*) AS n FROM pairs GROUP BY spec, att_term"""))
def q_attribute_counts(spark, sf_dir):
    return CV.attribute_counts(_pairs(spark, sf_dir))


GAPS_CTE = """
gap_atts AS (SELECT spec, term AS att_term, CAST(min(side) AS INTEGER) AS side
             FROM spec_terms WHERE axis = 'attribute' GROUP BY spec, term),
gap_cnt AS (SELECT spec, att_term, count(*) AS n FROM pairs GROUP BY spec, att_term),
gap_j AS (SELECT a.spec, a.side, a.att_term, CAST(coalesce(c.n, 0) AS BIGINT) AS n
          FROM gap_atts a LEFT JOIN gap_cnt c ON c.spec = a.spec AND c.att_term = a.att_term),
gaps AS (SELECT spec, side, att_term, n, max(n) OVER (PARTITION BY spec) - n AS n_gap FROM gap_j)"""


@register("attribute_gaps", O.with_ctes(SPEC, *PAIRS_CTES, GAPS_CTE, body="SELECT * FROM gaps"))
def q_attribute_gaps(spark, sf_dir):
    return CV.attribute_gaps(_pairs(spark, sf_dir), FL.spec_table(spark))


@register("gap_total", O.with_ctes(SPEC, *PAIRS_CTES, GAPS_CTE, body="""
SELECT spec, CAST(coalesce(sum(n_gap), 0) AS BIGINT) AS gap_total FROM gaps GROUP BY spec"""))
def q_gap_total(spark, sf_dir):
    return CV.gap_total(CV.attribute_gaps(_pairs(spark, sf_dir), FL.spec_table(spark)))


@register("coverage_summary", O.with_ctes(SPEC, *PAIRS_CTES, GAPS_CTE, body=f"""
SELECT s.spec, s.n_sentences, s.n_covered, t.total_att_terms, g.gap_total,
  CASE WHEN s.n_covered >= t.total_att_terms AND g.gap_total > 0
         THEN printf({O.q(CV.MSG_ALL_WITH_GAP)}, 'Found', s.n_sentences, g.gap_total)
       WHEN s.n_covered >= t.total_att_terms THEN printf({O.q(CV.MSG_ALL)}, 'Found', s.n_sentences)
       ELSE printf({O.q(CV.MSG_PARTIAL)}, 'Found', s.n_sentences, s.n_covered, t.total_att_terms) END AS message
FROM (SELECT spec, count(*) AS n_sentences, count(DISTINCT att_term) AS n_covered FROM pairs GROUP BY spec) s
JOIN (SELECT spec, count(*) AS total_att_terms FROM spec_terms WHERE axis = 'attribute' GROUP BY spec) t ON t.spec = s.spec
JOIN (SELECT spec, CAST(coalesce(sum(n_gap), 0) AS BIGINT) AS gap_total FROM gaps GROUP BY spec) g ON g.spec = s.spec"""))
def q_coverage_summary(spark, sf_dir):
    return CV.coverage_summary(_pairs(spark, sf_dir), FL.spec_table(spark))


PAIR_GAPS_SQL = """
pg_grp AS (SELECT spec, side AS gside, pos AS gpos, term AS grp FROM spec_terms WHERE axis = 'group'),
pg_att AS (SELECT spec, side AS aside, pos AS apos, term AS att FROM spec_terms WHERE axis = 'attribute'),
pg_zip AS (SELECT a.spec, a.pos, a.term AS t0, b.term AS t1, least(a.term, b.term) || '/' || greatest(a.term, b.term) AS pair_key
           FROM spec_terms a JOIN spec_terms b ON a.spec = b.spec AND a.pos = b.pos
           WHERE a.axis = 'group' AND b.axis = 'group' AND a.side = 0 AND b.side = 1),
pg_occ AS (SELECT spec, pos, 0 AS side, t0 AS term, pair_key FROM pg_zip
           UNION ALL SELECT spec, pos, 1 AS side, t1 AS term, pair_key FROM pg_zip),
pg_own AS (SELECT spec, term, arg_min(pair_key, pos * 2 + side) AS own_key FROM pg_occ GROUP BY spec, term),
pg_perm AS (SELECT DISTINCT spec, pair_key FROM pg_zip),
pg_cnt AS (SELECT spec, grp_term_1 AS grp, att_term AS att,
                  least(grp_term_1, grp_term_2) || '/' || greatest(grp_term_1, grp_term_2) AS pair_key, count(*) AS cnt
           FROM pairs GROUP BY ALL),
pg_cells AS (SELECT g.spec, g.gside, g.gpos, a.aside, a.apos, g.grp, a.att, o.own_key
             FROM pg_grp g JOIN pg_att a ON a.spec = g.spec LEFT JOIN pg_own o ON o.spec = g.spec AND o.term = g.grp),
pg_j AS (SELECT c.*, k.pair_key, k.cnt, p.pair_key IS NOT NULL AS permitted,
                count(k.pair_key) OVER (PARTITION BY c.spec, c.gside, c.gpos, c.aside, c.apos) AS n_keys
         FROM pg_cells c LEFT JOIN pg_cnt k ON k.spec = c.spec AND k.grp = c.grp AND k.att = c.att
         LEFT JOIN pg_perm p ON p.spec = c.spec AND p.pair_key = k.pair_key),
pg_kept AS (SELECT * FROM pg_j WHERE pair_key IS NOT NULL AND (n_keys = 1 OR permitted)),
pg_rows AS (
  SELECT spec, pair_key, att, cnt FROM pg_kept
  UNION ALL
  SELECT c.spec, c.own_key AS pair_key, c.att, 0 AS cnt FROM pg_cells c
  WHERE NOT EXISTS (SELECT 1 FROM pg_kept k WHERE k.spec = c.spec AND k.gside = c.gside AND k.gpos = c.gpos
                    AND k.aside = c.aside AND k.apos = c.apos)
)"""


@register("pair_gaps", O.with_ctes(SPEC, *PAIRS_CTES, PAIR_GAPS_SQL, body="""
SELECT spec, pair_key, att AS att_term, CAST(sum(cnt) AS BIGINT) AS n,
       CAST(greatest(0, 2 - sum(cnt)) AS BIGINT) AS n_gap
FROM pg_rows GROUP BY spec, pair_key, att"""))
def q_pair_gaps(spark, sf_dir):
    return CV.pair_gaps(_pairs(spark, sf_dir), FL.spec_table(spark))


# ---------------------------------------------------------------- text and templates
@register("add_period", r"""
WITH p AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS idx
           FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS x FROM documents))
SELECT doc_id, CAST(idx - 1 AS INTEGER) AS sent_pos, """ + O.add_period("trim(raw)") + r""" AS with_period
FROM p WHERE length(trim(raw)) >= 1""")
def q_add_period(spark, sf_dir):
    from stereoscope.functions import patterns as P
    from stereoscope.sources import tables as TB
    d = TB.documents(spark, sf_dir)
    s = d.select("doc_id", F.posexplode(F.split("text", P.SENTENCE_SPLIT)).alias("sent_pos", "raw"))
    s = s.select("doc_id", F.col("sent_pos").cast("int").alias("sent_pos"), F.trim("raw").alias("t"))
    return s.where(F.length("t") >= 1).select("doc_id", "sent_pos", TX.add_period("t").alias("with_period"))


@register("mask_template", O.with_ctes(SPEC, *PAIRS_CTES, body=f"""
SELECT pair_id, {O.mask("sentence", "grp_term_1")} AS template FROM pairs"""))
def q_mask_template(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", TX.mask_term(F.col("sentence"), F.col("grp_term_1")).alias("template"))


@register("template_simple", O.with_ctes(SPEC, *PAIRS_CTES, body=f"""
SELECT pair_id, {O.mask("alt_sentence", "CASE WHEN instr(lower(alt_sentence), lower(grp_term_1)) > 0 THEN grp_term_1 ELSE grp_term_2 END")} AS template
FROM pairs"""))
def q_template_simple(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "pair_id", TX.template_simple(F.col("alt_sentence"), F.col("grp_term_1"), F.col("grp_term_2")).alias("template"))


@register("fill_template", O.with_ctes(SPEC, *PAIRS_CTES, body=f"""
SELECT pair_id, replace({O.mask("sentence", "grp_term_1")}, '[T]', grp_term_2) AS filled FROM pairs"""))
def q_fill_template(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "pair_id", TX.fill_template(TX.mask_term(F.col("sentence"), F.col("grp_term_1")), F.col("grp_term_2")).alias("filled"))


@register("template_refs", O.with_ctes(SPEC, *PAIRS_CTES, O.templ_cte("pairs"), body="""
SELECT pair_id, template, grp_refs FROM templ"""))
def q_template_refs(spark, sf_dir):
    t = TP.template_refs(_pairs(spark, sf_dir))
    return t.select("pair_id", "template", TP.refs_text(F.col("grp_refs")).alias("grp_refs"))


# ---------------------------------------------------------------- result shaping
FULL_CTES = O.pipeline(SPEC, "scored") + [O.templ_cte("pairs"), """
fullp AS (SELECT s.*, t.template, t.grp_refs, t.grp_refs_rev, t.refs FROM scored s JOIN templ t ON t.pair_id = s.pair_id)"""]


@register("template_scores", O.with_ctes(SPEC, *FULL_CTES, body="""
SELECT spec, model, pair_id, att_term, template, grp_term_1 || '/' || grp_term_2 AS groups, stereotyped,
       top_logit - bottom_logit AS score_delta,
       CASE WHEN label_1 = 'stereotype' THEN top_term ELSE bottom_term END AS stereotyped_version,
       CASE WHEN label_1 = 'anti-stereotype' THEN top_term ELSE bottom_term END AS anti_stereotyped_version,
       CASE WHEN label_1 = 'stereotype' THEN grp_term_1 ELSE grp_term_2 END AS stereotyped_term
FROM fullp"""))
def q_template_scores(spark, sf_dir):
    return M.template_scores(FL.scored_full(spark, sf_dir))


@register("signed_bias", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body="""
SELECT pair_id, model, CASE WHEN stereotyped = 1 THEN top_logit - bottom_logit
                            WHEN stereotyped = 0 THEN bottom_logit - top_logit END AS bias_score FROM scored"""))
def q_signed_bias(spark, sf_dir):
    return DP.signed_bias(FL.scored_pairs(spark, sf_dir)).select("pair_id", "model", "bias_score")


DISPLAY_CTE = """
disp AS (
  SELECT *, (coalesce(stereotyped = 1, false)) <> (label_1 = 'stereotype') AS swap,
         CASE WHEN stereotyped = 1 THEN top_logit - bottom_logit WHEN stereotyped = 0 THEN bottom_logit - top_logit END AS bias_score
  FROM fullp
),
display AS (
  SELECT spec, model, pair_id, doc_id, sent_pos, template, bias_score,
         CASE WHEN swap THEN grp_refs_rev ELSE grp_refs END AS grp_refs,
         CASE WHEN swap THEN list_transform(refs, lambda p: {'l': p.r, 'r': p.l}) ELSE refs END AS refs_list,
         CASE WHEN stereotyped = 1 THEN 'yes' WHEN stereotyped = 0 THEN 'no' ELSE 'Unknown' END AS "Stereotyped",
         att_term AS "Attribute",
         CASE WHEN swap THEN grp_term_2 || '/' || grp_term_1 ELSE grp_term_1 || '/' || grp_term_2 END AS "Groups",
         CASE WHEN swap THEN alt_sentence ELSE sentence END AS "Sentence",
         CASE WHEN swap THEN sentence ELSE alt_sentence END AS "Alternative"
  FROM disp
)"""


def _display(spark, sf_dir):
    return DP.display_pairs(FL.scored_full(spark, sf_dir))


@register("display_pairs", O.with_ctes(SPEC, *FULL_CTES, DISPLAY_CTE, body="""
SELECT spec, model, pair_id, bias_score, grp_refs, "Stereotyped", "Attribute", "Groups", "Sentence", "Alternative"
FROM display"""))
def q_display_pairs(spark, sf_dir):
    return _display(spark, sf_dir).select("spec", "model", "pair_id", "bias_score",
                                          TP.refs_text(F.col("grp_refs")).alias("grp_refs"), "Stereotyped",
                                          "Attribute", "Groups", "Sentence", "Alternative")


ATT_CTE = "att_scores AS (" + ATT_SCORES_SQL + ")"


@register("attribute_ranking", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), ATT_CTE, body="""
SELECT a.spec, a.model, t.side, a.att_term, a.score, a.n_pairs,
       CAST(row_number() OVER (PARTITION BY a.spec, a.model, t.side ORDER BY a.score DESC, a.att_term) AS INTEGER) AS rank
FROM att_scores a JOIN (SELECT DISTINCT spec, side, term FROM spec_terms WHERE axis = 'attribute') t
  ON t.spec = a.spec AND t.term = a.att_term"""))
def q_attribute_ranking(spark, sf_dir):
    return DP.attribute_ranking(M.attribute_scores(FL.scored_pairs(spark, sf_dir)), FL.spec_table(spark))


def _pct(x):
    return f"lpad(CAST(CAST(round_even({x} * 100.0, 0) AS BIGINT) AS VARCHAR), 2, ' ')"


@register("interpretation", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), ATT_CTE, f"""
sides AS (SELECT spec, replace(term, ' ', '-') AS k, min(side) AS side FROM spec_terms WHERE axis = 'attribute' GROUP BY ALL),
tops AS (
  SELECT * FROM (
    SELECT a.*, s.side, row_number() OVER (PARTITION BY a.spec, a.model, s.side ORDER BY a.score DESC, a.att_term) AS r
    FROM att_scores a JOIN sides s ON s.spec = a.spec AND s.k = replace(a.att_term, ' ', '-')) WHERE r = 1
),
top2 AS (SELECT spec, model, max(CASE WHEN side = 0 THEN att_term END) AS top_att_1, max(CASE WHEN side = 0 THEN score END) AS top_score_1,
                max(CASE WHEN side = 1 THEN att_term END) AS top_att_2, max(CASE WHEN side = 1 THEN score END) AS top_score_2
         FROM tops GROUP BY spec, model),
ms AS (SELECT spec, model, round(avg(score), 4) AS model_bias FROM att_scores GROUP BY spec, model),
ns AS (SELECT spec, count(*) AS n_sentences FROM scored GROUP BY spec),
gs AS (SELECT spec, string_agg(CASE WHEN side = 0 THEN '"' || term || '"' END, ', ' ORDER BY pos) AS g1,
              string_agg(CASE WHEN side = 1 THEN '"' || term || '"' END, ', ' ORDER BY pos) AS g2
       FROM spec_terms WHERE axis = 'group' AND pos < 2 GROUP BY spec),
na AS (SELECT spec, count(*) AS total_att FROM spec_terms WHERE axis = 'attribute' GROUP BY spec)""", body=f"""
SELECT t.spec, t.model, ns.n_sentences, (ns.n_sentences < na.total_att OR ns.n_sentences < 20) AS small_sample,
  t.top_att_1, t.top_score_1, t.top_att_2, t.top_score_2,
  printf({O.q(DP.INTERP_HEAD)}, t.model, ns.n_sentences)
  || CASE WHEN (ns.n_sentences < na.total_att OR ns.n_sentences < 20) THEN {O.q(DP.INTERP_SMALL)} ELSE '' END
  || printf({O.q(DP.INTERP_MODEL)}, {_pct("ms.model_bias")})
  || coalesce(printf({O.q(DP.INTERP_SIDE)}, t.top_att_1, 1, gs.g1, {_pct("t.top_score_1")}), '')
  || coalesce(printf({O.q(DP.INTERP_SIDE)}, t.top_att_2, 2, gs.g2, {_pct("t.top_score_2")}), '')
  || {O.q(DP.INTERP_TAIL)} AS message
FROM top2 t JOIN ms ON ms.spec = t.spec AND ms.model = t.model JOIN ns ON ns.spec = t.spec
JOIN gs ON gs.spec = t.spec JOIN na ON na.spec = t.spec"""))
def q_interpretation(spark, sf_dir):
    sp = FL.scored_pairs(spark, sf_dir, keep=True)
    ns = sp.groupBy("spec").agg(F.count(F.lit(1)).alias("n_sentences"))
    return DP.interpretation(M.attribute_scores(sp), M.model_score(sp), FL.spec_table(spark), ns)


@register("tiles", O.with_ctes(SPEC, *FULL_CTES, DISPLAY_CTE, ATT_CTE, """
att_side AS (SELECT spec, term AS att, min(side) AS side FROM spec_terms WHERE axis = 'attribute' GROUP BY ALL)""", body="""
SELECT d.spec, d.model, d."Attribute" AS att_term, s.side,
       row_number() OVER (PARTITION BY d.spec, d.model, d."Attribute"
                          ORDER BY CASE WHEN d."Stereotyped" = 'yes' THEN 0 ELSE 1 END, d.doc_id, d.sent_pos, d.pair_id) AS tile_no,
       d."Stereotyped" = 'yes' AS filled, s.side = 1 AS flip,
       replace(list_reduce(list_prepend({'l': NULL, 'r': NULL}, d.refs_list),
                           lambda acc, p: CASE WHEN p.l IS NULL THEN acc WHEN instr(acc, '[R]') > 0
                                               THEN substr(acc, 1, instr(acc, '[R]') - 1) || p.l || '/' || p.r || substr(acc, instr(acc, '[R]') + 3)
                                               ELSE acc END, d.template),
               '[T]', '[' || split_part(d."Groups", '/', 1) || '&#47;' || split_part(d."Groups", '/', 2) || ']') AS tooltip,
       CAST(round_even(a.score * 100.0, 0) AS BIGINT) AS percent
FROM display d JOIN att_side s ON s.spec = d.spec AND s.att = d."Attribute"
JOIN att_scores a ON a.spec = d.spec AND a.model = d.model AND a.att_term = d."Attribute"
WHERE d."Stereotyped" IN ('yes', 'no')"""))
def q_tiles(spark, sf_dir):
    sp = FL.scored_pairs(spark, sf_dir, keep=True)
    sf = FL.scored_full(spark, sf_dir, scored=sp)
    return DP.tiles(DP.display_pairs(sf, keep=("doc_id", "sent_pos")), M.attribute_scores(sp), FL.spec_table(spark))


# ---------------------------------------------------------------- sampling
@register("sample_per_attribute", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body="""
SELECT 0 AS rep, spec, model, att_term, pair_id, stereotyped, CAST(rn - 1 AS INTEGER) AS draw FROM (
  SELECT *, row_number() OVER (PARTITION BY spec, model, att_term ORDER BY md5('0|0|' || pair_id)) AS rn FROM scored)
WHERE rn <= 2"""))
def q_sample_per_attribute(spark, sf_dir):
    s = SM.sample_per_attribute(FL.scored_pairs(spark, sf_dir, keep=True), n=2, reps=1, seed=0)
    return s.select("rep", "spec", "model", "att_term", "pair_id", "stereotyped", F.col("draw").cast("int"))


@register("bootstrap_score", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), """
reps AS (SELECT CAST(range AS INTEGER) AS rep FROM range(30)),
smp AS (SELECT * FROM (
  SELECT r.rep, s.spec, s.model, s.att_term, s.stereotyped,
         row_number() OVER (PARTITION BY r.rep, s.spec, s.model, s.att_term
                            ORDER BY md5('0|' || CAST(r.rep AS VARCHAR) || '|' || s.pair_id)) AS rn
  FROM scored s, reps r) WHERE rn <= 2),
per_rep AS (SELECT rep, spec, model, avg(a) AS score FROM (
  SELECT rep, spec, model, att_term, avg(stereotyped) AS a FROM smp GROUP BY ALL) GROUP BY ALL)""", body="""
SELECT spec, model, count(*) AS n_reps, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std,
       round(quantile_cont(score, 0.025), 6) AS p025, round(quantile_cont(score, 0.975), 6) AS p975
FROM per_rep GROUP BY spec, model"""))
def q_bootstrap_score(spark, sf_dir):
    return SM.bootstrap_score(FL.scored_pairs(spark, sf_dir, keep=True), reps=30, n=2, seed=0)


# ---------------------------------------------------------------- generation planning
TARGETS_CTE = GAPS_CTE + """,
targets AS (
  SELECT t.spec, t.side, t.pos, t.term AS att_term, CAST(coalesce(g1.n_gap, g2.n_gap, 0) AS BIGINT) AS n_target
  FROM spec_terms t LEFT JOIN gaps g1 ON g1.spec = t.spec AND g1.att_term = t.term
  LEFT JOIN gaps g2 ON g2.spec = t.spec AND g2.att_term = replace(t.term, ' ', '-')
  WHERE t.axis = 'attribute'
)"""

PLAN_CTE = """
arr AS (SELECT spec, list(term ORDER BY pos) FILTER (WHERE axis = 'group' AND side = 0) AS g0,
               list(term ORDER BY pos) FILTER (WHERE axis = 'group' AND side = 1) AS g1 FROM spec_terms GROUP BY spec),
plan_r AS (
  SELECT t.spec, t.att_term, t.n_target, a.g0, a.g1, CAST(r.round AS INTEGER) AS round, CAST(sd.side AS INTEGER) AS side
  FROM targets t JOIN arr a ON a.spec = t.spec,
       LATERAL (SELECT unnest(range(0, CAST(ceil(t.n_target * 5 / 2.0) AS BIGINT))) AS round) r,
       (VALUES (0), (1)) sd(side)
  WHERE t.n_target > 0
),
plan AS (
  SELECT spec, att_term, round, side, round * 2 + side AS request,
    (CASE WHEN side = 0 THEN g0 ELSE g1 END)[CAST(('0x' || substr(md5('0|' || spec || '|' || att_term || '|' || round || '|' || side), 1, 8)) AS BIGINT) % len(CASE WHEN side = 0 THEN g0 ELSE g1 END) + 1] AS grp_term,
    (CASE WHEN side = 0 THEN g1 ELSE g0 END)[CAST(('0x' || substr(md5('0|' || spec || '|' || att_term || '|' || round || '|' || side), 1, 8)) AS BIGINT) % len(CASE WHEN side = 0 THEN g0 ELSE g1 END) + 1] AS partner
  FROM plan_r
)"""


def _targets(spark, sf_dir):
    st = FL.spec_table(spark)
    return GN.gen_targets(st, FL.materialize(CV.attribute_gaps(_pairs(spark, sf_dir), st)))


@register("gen_targets", O.with_ctes(SPEC, *PAIRS_CTES, TARGETS_CTE, body="SELECT * FROM targets"))
def q_gen_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@register("gen_plan", O.with_ctes(SPEC, *PAIRS_CTES, TARGETS_CTE, PLAN_CTE, body="SELECT * FROM plan"))
def q_gen_plan(spark, sf_dir):
    return GN.gen_plan(_targets(spark, sf_dir), FL.spec_table(spark))


@register("gen_fill", O.with_ctes(SPEC, *PAIRS_CTES, TARGETS_CTE, PLAN_CTE, """
att_hits AS (SELECT DISTINCT spec, term AS att_term, doc_id, sent_pos, sentence FROM hits WHERE axis = 'attribute'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY spec, att_term ORDER BY doc_id, sent_pos) AS no, count(*) OVER (PARTITION BY spec, att_term) AS cnt FROM att_hits),
cnts AS (SELECT DISTINCT spec, att_term, cnt FROM numbered),
asks AS (SELECT p.*, t.try, ('0x' || substr(md5('0|' || p.spec || '|' || p.att_term || '|' || p.request || '|' || t.try), 1, 8))::BIGINT % c.cnt + 1 AS no
         FROM plan p CROSS JOIN range(10) t(try) LEFT JOIN cnts c ON c.spec = p.spec AND c.att_term = p.att_term),
answered AS (
  SELECT a.spec, a.att_term, a.round, a.request,
         min(a.try) FILTER (WHERE regexp_matches(lower(n.sentence), lower(a.grp_term) || '[ .,!]') AND regexp_matches(lower(n.sentence), lower(a.att_term) || '[ .,!]')) AS good
  FROM asks a LEFT JOIN numbered n ON n.spec = a.spec AND n.att_term = a.att_term AND n.no = a.no GROUP BY ALL),
per_round AS (SELECT spec, att_term, round, count(good) AS got, sum(coalesce(good + 1, 10)) AS tries, count(*) AS requests FROM answered GROUP BY ALL),
so_far AS (SELECT *, sum(got) OVER (PARTITION BY spec, att_term ORDER BY round) AS total FROM per_round),
fill AS (
  SELECT s.spec, s.att_term, sum(requests)::BIGINT AS n_requests, sum(tries)::BIGINT AS n_tries, sum(got)::BIGINT AS got
  FROM so_far s JOIN targets t ON t.spec = s.spec AND t.att_term = s.att_term WHERE s.total - s.got < t.n_target GROUP BY ALL)""", body="""
SELECT t.spec, t.att_term, t.n_target, coalesce(f.n_requests, 0) AS n_requests, coalesce(f.n_tries, 0) AS n_tries,
       least(coalesce(f.got, 0), t.n_target) AS n_accepted, greatest(t.n_target - coalesce(f.got, 0), 0) AS n_unmet
FROM targets t LEFT JOIN fill f ON f.spec = t.spec AND f.att_term = t.att_term"""))
def q_gen_fill(spark, sf_dir):
    """C6 with retries: corpus sentences answer the requests until each attribute's gap is filled."""
    st = FL.spec_table(spark)
    return GN.fill_to_targets(_targets(spark, sf_dir), st, MI.corpus_answers(FL.sentences(spark, sf_dir), st), ahead=PT.GEN_TRIES)["report"]


@register("gen_prompts", O.with_ctes(SPEC, *PAIRS_CTES, TARGETS_CTE, PLAN_CTE, """
ctx AS (SELECT p.spec, p.att_term, p.request, t.axis, t.term,
               md5('0|' || p.spec || '|' || p.att_term || '|' || p.request || '|' ||
                   CASE WHEN t.axis = 'group' THEN 'g' ELSE 'a' END || '|' || t.term) AS h
        FROM plan p JOIN spec_terms t ON t.spec = p.spec),
ctx8 AS (SELECT *, row_number() OVER (PARTITION BY spec, att_term, request, axis ORDER BY h, term) AS rn FROM ctx),
ctxs AS (SELECT spec, att_term, request,
           string_agg(chr(39) || term || chr(39), ',' ORDER BY h, term) FILTER (WHERE axis = 'group' AND rn <= 8) AS g_ctx,
           string_agg(chr(39) || term || chr(39), ',' ORDER BY h, term) FILTER (WHERE axis = 'attribute' AND rn <= 8) AS a_ctx
         FROM ctx8 GROUP BY spec, att_term, request)""", body=f"""
SELECT p.spec, p.att_term, p.request, p.grp_term, p.partner,
       printf({O.q(__import__("stereoscope.functions.patterns", fromlist=["x"]).GEN_INSTRUCTION)}, p.grp_term, p.att_term, c.g_ctx, c.a_ctx) AS instruction
FROM plan p JOIN ctxs c ON c.spec = p.spec AND c.att_term = p.att_term AND c.request = p.request"""))
def q_gen_prompts(spark, sf_dir):
    st = FL.spec_table(spark)
    return GN.gen_prompts(GN.gen_plan(_targets(spark, sf_dir), st), st)


@register("downsample_to_target", O.with_ctes(SPEC, *PAIRS_CTES, TARGETS_CTE, body="""
SELECT pair_id, spec, att_term, n_target, keep_rank FROM (
  SELECT p.pair_id, p.spec, p.att_term, t.n_target,
         row_number() OVER (PARTITION BY p.spec, p.att_term ORDER BY md5('0|' || p.pair_id)) AS keep_rank
  FROM pairs p JOIN targets t ON t.spec = p.spec AND t.att_term = p.att_term) WHERE keep_rank <= n_target"""))
def q_downsample_to_target(spark, sf_dir):
    pairs = FL.materialize(_pairs(spark, sf_dir))
    st = FL.spec_table(spark)
    d = GN.downsample_to_target(pairs, GN.gen_targets(st, CV.attribute_gaps(pairs, st)))
    return d.select("pair_id", "spec", "att_term", "n_target", F.col("keep_rank"))


REC_CTES = O.pipeline(SPEC, "labelled") + [O.spec_names_cte(), O.record_cte()]
REC_COLS = ("spec, pair_id, sentence, alt_sentence, org_grp_term, att_term, template, alt_template, grp_term1, "
            "grp_term2, grp_refs, label_1, label_2, bias_spec, type, gen_model")


@register("generation_record", O.with_ctes(SPEC, *REC_CTES, body=f"SELECT {REC_COLS} FROM records"))
def q_generation_record(spark, sf_dir):
    return FL.generation_records(spark, FL.labelled_pairs(spark, sf_dir)).drop("doc_id")


# ---------------------------------------------------------------- sentence bank
RSPEC = FL.retrieval_spec()
BANK_COLS = ("pair_id, sentence, alt_sentence, org_grp_term, att_term, template, alt_template, grp_term1, grp_term2, "
             "grp_refs, label_1, label_2, bias_spec, type, gen_model")


def _bank_sql(prefix: str, src: str | None) -> list[str]:
    return O.pipeline(SPEC, "labelled", src=src, prefix=prefix) + [O.record_cte(prefix, prefix + "records"), f"""
{prefix}bank AS (
  SELECT pair_id, sentence, alt_sentence, org_grp_term, att_term, template, alt_template, grp_term1, grp_term2,
         grp_refs, label_1, label_2, bias_spec,
         ['tool', 'paper', NULL][doc_id % 3 + 1] AS type,
         ['gpt-3.5-turbo', 'gpt-4', 'gpt-3.5', 'text-davinci-003'][doc_id % 4 + 1] AS gen_model
  FROM {prefix}records)"""]


BANK_CTES = [O.spec_names_cte()] + _bank_sql("", None)
RSPEC_CTE = O.spec_values(RSPEC, "rspec_terms")
GEN_MODELS_SQL = "('gpt-3.5', 'gpt-3.5-turbo', 'gpt-4')"


def _rspec(spark):
    from stereoscope.sources.specs import spec_terms
    return spec_terms(spark, RSPEC)


@register("bank_scan", O.with_ctes(SPEC, *BANK_CTES, RSPEC_CTE, body="""
SELECT r.spec, CAST(r.side AS INTEGER) AS read_side, CAST(r.pos AS INTEGER) AS read_pos, b.org_grp_term, b.pair_id, b.att_term
FROM bank b JOIN rspec_terms r ON r.axis = 'group' AND r.term = b.org_grp_term"""))
def q_bank_scan(spark, sf_dir):
    return (BK.bank_scan(FL.derived_bank(spark, sf_dir), _rspec(spark))
            .select("spec", "read_side", "read_pos", "org_grp_term", "pair_id", "att_term"))


@register("bank_filter", O.with_ctes(SPEC, *BANK_CTES, body=f"""
SELECT pair_id, org_grp_term, type, gen_model FROM bank WHERE type IS NULL OR gen_model IN {GEN_MODELS_SQL}"""))
def q_bank_filter(spark, sf_dir):
    return BK.bank_filter(FL.derived_bank(spark, sf_dir)).select("pair_id", "org_grp_term", "type", "gen_model")


@register("retrieve_pairs", O.with_ctes(SPEC, *BANK_CTES, RSPEC_CTE, f"""
variants AS (SELECT DISTINCT spec, v FROM (
  SELECT spec, unnest([term, replace(term, ' ', '-'), replace(term, ' ', '')]) AS v FROM rspec_terms WHERE axis = 'attribute')),
rgroups AS (SELECT DISTINCT spec, term FROM rspec_terms WHERE axis = 'group')""", body=f"""
SELECT r.spec, CAST(r.side AS INTEGER) AS read_side, CAST(r.pos AS INTEGER) AS read_pos, b.sentence, b.alt_sentence,
       b.grp_term1 AS grp_term_1, b.grp_term2 AS grp_term_2, b.att_term
FROM bank b JOIN rspec_terms r ON r.axis = 'group' AND r.term = b.org_grp_term
WHERE (b.type IS NULL OR b.gen_model IN {GEN_MODELS_SQL})
  AND EXISTS (SELECT 1 FROM variants v WHERE v.spec = r.spec AND v.v = b.att_term)
  AND EXISTS (SELECT 1 FROM rgroups g WHERE g.spec = r.spec AND g.term = b.grp_term1)
  AND EXISTS (SELECT 1 FROM rgroups g WHERE g.spec = r.spec AND g.term = b.grp_term2)"""))
def q_retrieve_pairs(spark, sf_dir):
    return BK.retrieve_pairs(FL.derived_bank(spark, sf_dir), _rspec(spark))


def _legacy(bank):
    return bank.select("org_grp_term", "type", "gen_model",
                       F.translate("grp_term1", " ", "-").alias("Group term"),
                       F.translate("att_term", " ", "-").alias("Attribute term"),
                       F.col("sentence").alias("Test sentence"))


@register("retrieve_legacy", O.with_ctes(SPEC, *BANK_CTES, RSPEC_CTE, """
variants AS (SELECT DISTINCT spec, v FROM (
  SELECT spec, unnest([term, replace(term, ' ', '-'), replace(term, ' ', '')]) AS v FROM rspec_terms WHERE axis = 'attribute'))""",
  body=f"""
SELECT r.spec, b.sentence, replace(replace(b.grp_term1, ' ', '-'), '-', ' ') AS grp_term,
       replace(replace(b.att_term, ' ', '-'), '-', ' ') AS att_term
FROM bank b JOIN rspec_terms r ON r.axis = 'group' AND r.term = b.org_grp_term
WHERE b.type = 'paper' AND b.gen_model IN {GEN_MODELS_SQL}
  AND EXISTS (SELECT 1 FROM variants v WHERE v.spec = r.spec AND v.v = replace(b.att_term, ' ', '-'))"""))
def q_retrieve_legacy(spark, sf_dir):
    return BK.retrieve_legacy(_legacy(FL.derived_bank(spark, sf_dir)), _rspec(spark))


CONV_BANK = _bank_sql("c_", O.CONV_SRC)


@register("bank_append_dedupe", O.with_ctes(SPEC, *BANK_CTES, *CONV_BANK, """
newrows AS (SELECT * FROM c_bank UNION ALL
            SELECT pair_id, sentence, alt_sentence, org_grp_term, att_term, template, alt_template, grp_term1, grp_term2,
                   grp_refs, label_1, label_2, bias_spec, type, 'gpt-4' AS gen_model FROM bank),
both_ AS (SELECT *, 0 AS origin FROM bank UNION ALL SELECT *, 1 AS origin FROM newrows)""", body="""
SELECT org_grp_term, sentence, pair_id, origin, gen_model FROM (
  SELECT *, row_number() OVER (PARTITION BY org_grp_term, sentence ORDER BY origin, pair_id) AS r FROM both_) WHERE r = 1"""))
def q_bank_append_dedupe(spark, sf_dir):
    old = FL.materialize(FL.derived_bank(spark, sf_dir))
    new = FL.derived_bank(spark, sf_dir, corpus="conversations").unionByName(old.withColumn("gen_model", F.lit("gpt-4")))
    d = BK.append_dedupe(old, new, order_col="pair_id")
    return d.select("org_grp_term", "sentence", "pair_id", F.col("_origin").alias("origin"), "gen_model")


@register("combine_sentences", O.with_ctes(SPEC, *BANK_CTES, *CONV_BANK, body="""
SELECT sentence, alt_sentence, grp_term1 AS grp_term_1, grp_term2 AS grp_term_2, att_term FROM bank
UNION ALL SELECT sentence, alt_sentence, grp_term1, grp_term2, att_term FROM c_bank"""))
def q_combine_sentences(spark, sf_dir):
    cols = [F.col("sentence"), F.col("alt_sentence"), F.col("grp_term1").alias("grp_term_1"),
            F.col("grp_term2").alias("grp_term_2"), F.col("att_term")]
    return BK.combine_sentences(FL.derived_bank(spark, sf_dir).select(*cols),
                                FL.derived_bank(spark, sf_dir, corpus="conversations").select(*cols))


@register("bank_csv", O.with_ctes(SPEC, *BANK_CTES, body=f"SELECT {BANK_COLS.replace('pair_id, ', '')} FROM bank"))
def q_bank_csv(spark, sf_dir):
    """The bank written as the measured tool stores it, one CSV file per term, and read back by its headers."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bank-csv-{uuid.uuid4().hex}"
    BK.write_bank_csv(FL.derived_bank(spark, sf_dir), folder)
    return BK.read_bank_csv(spark, folder)


# ---------------------------------------------------------------- spec registry over the corpus
REGISTRY = SP.registry_python()


def _registry_values() -> str:
    rows = []
    for d in REGISTRY:
        for axis, key in (("group", "social_groups"), ("attribute", "attributes")):
            for side, (_, terms) in enumerate(list(d[key].items())[:2]):
                for pos, t in enumerate(terms):
                    rows.append(f"({O.q(d['tag'])}, {O.q(d['label'])}, {O.q(d['type'])}, {O.q(axis)}, {side}, {pos}, {O.q(t)})")
    return "reg(spec, label, type, axis, side, pos, term) AS (VALUES " + ", ".join(rows) + ")"


@register("spec_terms", O.with_ctes(SPEC, O.SENTS, O.SENT_WORDS, _registry_values(), body="""
SELECT t.spec, t.label, t.type, t.axis, CAST(t.side AS INTEGER) AS side, CAST(t.pos AS INTEGER) AS pos, t.term,
       count(s.doc_id) AS n_sentences
FROM reg t LEFT JOIN sent_words s ON s.word = regexp_split_to_array(lower(t.term), '[ .,!]+')[1]
  AND regexp_matches(lower(s.sentence), '(^| )' || lower(t.term) || '[ .,!]')
GROUP BY ALL"""))
def q_spec_terms(spark, sf_dir):
    """A1/A2/A5 read, list text, B1 parse, B3 balance, B2 term table, A3 labels;
    then how many corpus sentences hold each term (strict boundaries)."""
    specs = SP.registry_specs(spark)
    terms = SP.specs_to_terms(specs, spec_col="tag")
    parsed = SM.balance_lists(SO.parse_term_text(SO.prefill_text(terms, n=None)))
    tk = SP.bounded(MI.term_keys(parsed))
    hits = (MI.candidate_words(FL.sentences(spark, sf_dir), ["doc_id", "sent_pos"])
            .join(tk, "key").where(F.col("simple") | F.expr("ls rlike accept_re"))
            .groupBy("spec", "axis", "side", "pos").agg(F.count(F.lit(1)).alias("n_sentences")))
    labels = specs.select(F.col("tag").alias("spec"), "label", "type")
    return (parsed.join(labels, "spec").join(hits, ["spec", "axis", "side", "pos"], "left")
            .select("spec", "label", "type", "axis", "side", "pos", "term",
                    F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences")))


# ---------------------------------------------------------------- scoring variants
MASKED_SQL = r"""
mvar AS (SELECT pair_id, variant, """ + O.TOKENS.format(x="text") + r""" AS t,
                list_filter(regexp_split_to_array(lower(target), '[^a-z]+'), lambda w: w <> '') AS tt FROM variants),
mfirst AS (SELECT *, list_filter(range(2, len(t) - len(tt) + 2), lambda i: t[i:i + len(tt) - 1] = tt)[1] AS first FROM mvar WHERE len(tt) > 0),
msub AS (SELECT pair_id, variant, k, tt[k + 1] AS tok, t[first + k - 1] AS lft, t[first + k + 1] AS rgt
         FROM (SELECT *, unnest(range(0, len(tt))) AS k FROM mfirst WHERE first IS NOT NULL)),
mlog AS (
  SELECT m.pair_id, m.variant,
    ln((coalesce(b1.c12, 0) + 1.0) / (coalesce(h1.c1, 0) + (SELECT v FROM vocab)))
    + CASE WHEN m.rgt IS NULL THEN 0.0 ELSE ln((coalesce(b2.c12, 0) + 1.0) / (coalesce(h2.c1, 0) + (SELECT v FROM vocab))) END AS logit
  FROM msub m
  LEFT JOIN bigrams b1 ON b1.w1 = m.lft AND b1.w2 = m.tok LEFT JOIN hist h1 ON h1.w1 = m.lft
  LEFT JOIN bigrams b2 ON b2.w1 = m.tok AND b2.w2 = m.rgt LEFT JOIN hist h2 ON h2.w1 = m.tok
),
masked AS (SELECT pair_id, 'bigram-lm-masked' AS model,
                  round(avg(CASE WHEN variant = 0 THEN logit END), 6) AS r0,
                  round(avg(CASE WHEN variant = 1 THEN logit END), 6) AS r1 FROM mlog GROUP BY pair_id),
mranked AS (
  SELECT l.*, 'bigram-lm-masked' AS model, c.r0, c.r1, c.r0 IS NOT NULL AND c.r1 IS NOT NULL AS testable
  FROM labelled l LEFT JOIN masked c ON c.pair_id = l.pair_id
),
mcoin AS (
  SELECT *, CASE WHEN testable THEN r0 ELSE CAST(CAST(('0x' || substr(md5('0|' || pair_id), 1, 8)) AS BIGINT) % 2 AS DOUBLE) END AS q0,
            CASE WHEN testable THEN r1 ELSE 1.0 - CAST(CAST(('0x' || substr(md5('0|' || pair_id), 1, 8)) AS BIGINT) % 2 AS DOUBLE) END AS q1
  FROM mranked
),
mscored AS (
  SELECT *, CAST((CASE WHEN q0 > q1 THEN label_1 ELSE label_2 END) = 'stereotype' AS INTEGER) AS stereotyped FROM mcoin
)"""
MASKED_CTES = O.pipeline(SPEC, "losses") + [MASKED_SQL]


@register("score_masked", O.with_ctes(SPEC, *MASKED_CTES, body="SELECT pair_id, model, r0, r1 FROM masked"))
def q_score_masked(spark, sf_dir):
    read = FL.materialize(SC.masked_bigrams(FL.labelled_pairs(spark, sf_dir)))
    return SC.masked_scores(SC.lm_token_logits(read, FL.language_model(spark, sf_dir, read)))


@register("score_failsafe", O.with_ctes(SPEC, *MASKED_CTES, body="""
SELECT pair_id, model, testable, stereotyped FROM mscored"""))
def q_score_failsafe(spark, sf_dir):
    return FL.masked_scored_pairs(spark, sf_dir, failsafe="coin").select("pair_id", "model", "testable", "stereotyped")


def _model_values() -> str:
    return "models(model) AS (VALUES " + ", ".join(f"({O.q(m)})" for m in MODELS) + ")"


MODELS = (*PT.MODEL_CHOICES, "bigram-lm", "bigram-lm-masked")


@register("model_kind", O.with_ctes(SPEC, *MASKED_CTES, *O.pipeline(SPEC, "scored")[len(MASKED_CTES) - 1:],
                                    _model_values(), """
kinds AS (SELECT model, CASE WHEN model = 'bigram-lm' THEN 'causal' WHEN model = 'bigram-lm-masked' THEN 'masked'
                             WHEN lower(model) LIKE '%bert%' THEN 'masked' WHEN lower(model) LIKE '%gpt%' THEN 'causal'
                             WHEN lower(model) LIKE '%llama%' THEN 'causal' WHEN lower(model) LIKE '%falcon%' THEN 'causal'
                             ELSE 'unscored' END AS kind FROM models),
own AS (
  SELECT 'bigram-lm' AS model, round(avg(s), 4) AS model_bias, CAST(sum(n) AS BIGINT) AS num_templates
  FROM (SELECT att_term, avg(stereotyped) AS s, count(*) AS n FROM scored GROUP BY att_term)
  UNION ALL
  SELECT 'bigram-lm-masked' AS model, round(avg(s), 4), CAST(sum(n) AS BIGINT)
  FROM (SELECT att_term, avg(stereotyped) AS s, count(*) AS n FROM mscored WHERE testable GROUP BY att_term)
)""", body="""
SELECT k.model, k.kind, p.model IS NOT NULL AS scored, coalesce(p.model_bias, 0) AS model_bias, coalesce(p.num_templates, 0) AS num_templates
FROM kinds k LEFT JOIN own p ON p.model = k.model"""))
def q_model_kind(spark, sf_dir):
    """The kind of every model offered; scores only for the built-in models, which ran."""
    models = SC.model_kind(spark.createDataFrame([(m,) for m in MODELS], "model string"))
    lp = FL.materialize(FL.labelled_pairs(spark, sf_dir))
    units = FL.pair_units(lp)
    lm = FL.language_model(spark, sf_dir, units)
    causal = M.model_score(FL.scored_pairs(spark, sf_dir, lm=lm, lp=lp, units=units))
    masked = M.model_score(FL.masked_scored_pairs(spark, sf_dir, lm=lm.of_units(), lp=lp))
    own = causal.unionByName(masked).select("model", "model_bias", "num_templates")
    return models.join(own, "model", "left").select("model", "kind", F.col("num_templates").isNotNull().alias("scored"),
                                                    F.coalesce("model_bias", F.lit(0.0)).alias("model_bias"),
                                                    F.coalesce("num_templates", F.lit(0)).cast("long").alias("num_templates"))


# ---------------------------------------------------------------- label variants and rejects
@register("pair_labels_by_index", O.with_ctes(SPEC, *PAIRS_CTES, """
lists AS (SELECT spec, list(term ORDER BY pos) FILTER (WHERE axis = 'group' AND side = 0) AS l0,
                 list(term ORDER BY pos) FILTER (WHERE axis = 'group' AND side = 1) AS l1 FROM spec_terms GROUP BY spec),
asides AS (SELECT spec, replace(term, ' ', '-') AS k, min(side) AS s FROM spec_terms WHERE axis = 'attribute' GROUP BY ALL),
j AS (SELECT p.spec, p.pair_id, p.grp_term_1, p.att_term, a.s, list_position(l.l0, p.grp_term_1) AS i0,
             list_position(l.l1, p.grp_term_1) AS i1, l.l0, l.l1
      FROM pairs p JOIN lists l ON l.spec = p.spec JOIN asides a ON a.spec = p.spec AND a.k = replace(p.att_term, ' ', '-'))""",
  body="""
SELECT spec, pair_id, grp_term_1,
  CASE WHEN coalesce(i0, 0) > 0 THEN l1[i0] ELSE l0[i1] END AS grp_term_2, att_term,
  CASE WHEN (s = 0) = (coalesce(i0, 0) > 0) THEN 'stereotype' ELSE 'anti-stereotype' END AS label_1,
  CASE WHEN (s = 0) = (coalesce(i0, 0) > 0) THEN 'anti-stereotype' ELSE 'stereotype' END AS label_2
FROM j WHERE coalesce(i0, 0) > 0 OR coalesce(i1, 0) > 0"""))
def q_pair_labels_by_index(spark, sf_dir):
    return PR.pair_labels_by_index(_pairs(spark, sf_dir), FL.spec_table(spark))


@register("pair_rejects", O.with_ctes(SPEC, *PAIRS_CTES, RSPEC_CTE, f"""
rp AS (SELECT {O.q(RSPEC.name)} AS spec, pair_id, grp_term_1, grp_term_2, att_term FROM pairs),
ra AS (SELECT spec, replace(term, ' ', '-') AS k, min(side) AS s FROM rspec_terms WHERE axis = 'attribute' GROUP BY ALL),
rg AS (SELECT spec, term, min(side) AS s FROM rspec_terms WHERE axis = 'group' GROUP BY ALL),
rg2 AS (SELECT spec, term, list(DISTINCT side) AS sides FROM rspec_terms WHERE axis = 'group' GROUP BY ALL),
rj AS (SELECT rp.spec, rp.pair_id, ra.s AS att_s, rg.s AS grp_s, rg2.sides
       FROM rp LEFT JOIN ra ON ra.spec = rp.spec AND ra.k = replace(rp.att_term, ' ', '-')
       LEFT JOIN rg ON rg.spec = rp.spec AND rg.term = rp.grp_term_1
       LEFT JOIN rg2 ON rg2.spec = rp.spec AND rg2.term = rp.grp_term_2)""", body="""
SELECT spec, pair_id, 'attribute not in spec' AS reason FROM rj WHERE att_s IS NULL
UNION ALL SELECT spec, pair_id, 'group term 1 not in spec' FROM rj WHERE grp_s IS NULL
UNION ALL SELECT spec, pair_id, 'group term 2 not on the opposite side' FROM rj
  WHERE grp_s IS NOT NULL AND NOT coalesce(list_contains(sides, 1 - grp_s), false)"""))
def q_pair_rejects(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("spec", F.lit(RSPEC.name))
    return PR.pair_rejects(p, _rspec(spark))


# ---------------------------------------------------------------- batch inference hook and sinks
def _char_loss(texts, targets):
    """Example predict function for the hook: mean word length of the text (no model needed)."""
    import numpy as np
    return [float(np.mean([len(w) for w in t.split()])) if t.split() else 0.0 for t in texts]


@register("score_batch_hook", O.with_ctes(SPEC, *O.pipeline(SPEC, "labelled"), """
hv AS (SELECT pair_id, 0 AS variant, sentence AS text FROM labelled
       UNION ALL SELECT pair_id, 1 AS variant, alt_sentence AS text FROM labelled),
hw AS (SELECT pair_id, variant,
              list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM hv),
hl AS (SELECT pair_id, variant,
              CASE WHEN len(ws) = 0 THEN 0.0 ELSE list_sum(list_transform(ws, lambda w: length(w))) / len(ws) END AS loss
       FROM hw),
hr AS (SELECT pair_id, greatest(l0, l1) - l0 AS r0, greatest(l0, l1) - l1 AS r1 FROM (
         SELECT pair_id, max(CASE WHEN variant = 0 THEN loss END) AS l0, max(CASE WHEN variant = 1 THEN loss END) AS l1
         FROM hl GROUP BY pair_id))""", body="""
SELECT l.pair_id, 'mean-word-length' AS model,
       CAST((CASE WHEN r.r0 > r.r1 THEN l.label_1 ELSE l.label_2 END) = 'stereotype' AS INTEGER) AS stereotyped,
       CASE WHEN r.r0 > r.r1 THEN l.grp_term_1 ELSE l.grp_term_2 END AS top_term
FROM labelled l JOIN hr r ON r.pair_id = l.pair_id"""))
def q_score_batch_hook(spark, sf_dir):
    lp = FL.labelled_pairs(spark, sf_dir)
    vs = SC.batch_inference_scores(lp, _char_loss, model="mean-word-length")
    return SC.pair_winner(lp, SC.causal_scores(vs)).select("pair_id", "model", "stereotyped", "top_term")


@register("export_pairs", O.with_ctes(SPEC, *FULL_CTES, DISPLAY_CTE, O.spec_names_cte(), body="""
SELECT 'test_pairs_' || n.bias_name || '.csv' AS file_name,
       row_number() OVER (PARTITION BY n.bias_name ORDER BY d.doc_id, d.sent_pos, d.pair_id, d.model) - 1 AS row_id, d."Stereotyped", d."Attribute",
       d."Groups", d."Sentence", d."Alternative"
FROM display d JOIN names n ON n.spec = d.spec"""))
def q_export_pairs(spark, sf_dir):
    display = DP.display_pairs(FL.scored_full(spark, sf_dir), keep=("doc_id", "sent_pos"))
    return SK.export_frame(display, GN.spec_names(FL.spec_table(spark)), order=["doc_id", "sent_pos"])


STAMP = "01/01/2024 00:00:00"


@register("test_result_record", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), O.spec_names_cte(), body=f"""
SELECT n.bias_name AS name, 'stereoscope' AS source, s.spec, s.model AS tested_model, 'custom' AS type, {O.q(STAMP)} AS created
FROM (SELECT DISTINCT spec, model FROM scored) s JOIN names n ON n.spec = s.spec"""))
def q_test_result_record(spark, sf_dir):
    r = SK.test_result_records(M.model_score(FL.scored_pairs(spark, sf_dir)), GN.spec_names(FL.spec_table(spark)), created=STAMP)
    return r.select("name", "source", "spec", F.col("tested_results.tested_model").alias("tested_model"), "type", "created")


# ---------------------------------------------------------------- acceptance, prompts, run summary
@register("accept_candidates", O.with_ctes(SPEC, *PAIRS_CTES, body="""
SELECT pair_id,
  regexp_matches(lower(alt_sentence), lower(grp_term_2) || '[ .,!]') AND regexp_matches(lower(alt_sentence), lower(att_term) || '[ .,!]') AS accepted,
  regexp_matches(lower(alt_sentence), '(^| )' || lower(grp_term_2) || '[ .,!]')
    AND regexp_matches(lower(alt_sentence), '(^| )' || lower(att_term) || '[ .,!]') AS accepted_strict
FROM pairs"""))
def q_accept_candidates(spark, sf_dir):
    """C4 on the counterfactual variants: the measured rule (no left boundary) next to the strict one."""
    p = _pairs(spark, sf_dir)
    return p.select("pair_id", MI.accepts("alt_sentence", "grp_term_2", "att_term").alias("accepted"),
                    MI.accepts("alt_sentence", "grp_term_2", "att_term", strict=True).alias("accepted_strict"))


@register("rewrite_prompts", O.with_ctes(SPEC, *PAIRS_CTES, body=f"""
SELECT pair_id, printf({O.q(PT.REWRITE_INSTRUCTION)}, grp_term_1, grp_term_2) AS instruction,
       printf({O.q(PT.REWRITE_PROMPT)}, sentence) AS prompt FROM pairs"""))
def q_rewrite_prompts(spark, sf_dir):
    return GN.rewrite_prompts(_pairs(spark, sf_dir))


@register("fewshot_prompts", O.with_ctes(SPEC, *PAIRS_CTES, TARGETS_CTE, PLAN_CTE, """
shots AS (SELECT spec, att_term, shot_no, grp_term_1 AS k0, att_term AS k1, sentence FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY spec, att_term ORDER BY md5('0|' || pair_id)) AS INTEGER) AS shot_no FROM pairs)
  WHERE shot_no <= 2),
heads AS (SELECT spec, att_term, string_agg(printf('Keywords: %s, %s ## Sentence: %s ##' || chr(10), k0, k1, sentence), ''
                                             ORDER BY shot_no) AS head FROM shots GROUP BY spec, att_term)""", body="""
SELECT p.spec, p.att_term, p.request, coalesce(h.head, '') || printf('Keywords: %s, %s ## Sentence: ', p.grp_term, p.att_term) AS prompt
FROM plan p LEFT JOIN heads h ON h.spec = p.spec AND h.att_term = p.att_term"""))
def q_fewshot_prompts(spark, sf_dir):
    """C7 few-shot form: two seeded mined sentences of the attribute as examples for every request."""
    pairs = FL.materialize(_pairs(spark, sf_dir))
    st = FL.spec_table(spark)
    plan = GN.gen_plan(GN.gen_targets(st, CV.attribute_gaps(pairs, st)), st)
    shots = (SM.top_n_per_group(pairs, ["spec", "att_term"], [GN.seeded_rank(0, "pair_id")], 2, out="shot_no")
             .select("spec", "att_term", "shot_no", F.col("grp_term_1").alias("k0"), F.col("att_term").alias("k1"),
                     "sentence"))
    return GN.fewshot_prompts(plan, shots)


@register("run_summary", O.with_ctes(SPEC, *O.pipeline(SPEC, "scored"), body="""
SELECT spec, model, CAST(sum(n) AS BIGINT) AS num_templates, round(avg(s), 4) AS model_bias, round(avg(s), 4) AS per_bias,
       printf('Stereotype Score on %s using %d sentences', upper(model), CAST(sum(n) AS BIGINT)) AS title
FROM (SELECT spec, model, att_term, avg(stereotyped) AS s, count(*) AS n FROM scored GROUP BY spec, model, att_term)
GROUP BY spec, model"""))
def q_run_summary(spark, sf_dir):
    return M.run_summary(FL.scored_pairs(spark, sf_dir))


# ---------------------------------------------------------------- spec operators over the corpus
SUPPORT_SQL = O.SENT_WORDS + """,
support AS (SELECT t.term, count(s.doc_id) AS n_sentences
            FROM (SELECT DISTINCT term FROM {terms}) t
            LEFT JOIN sent_words s ON s.word = regexp_split_to_array(lower(t.term), '[ .,!]+')[1]
              AND regexp_matches(lower(s.sentence), '(^| )' || lower(t.term) || '[ .,!]')
            GROUP BY t.term)"""


def _registry_terms(spark):
    return SP.specs_to_terms(SP.registry_specs(spark), spec_col="tag")


@register("spec_parse", O.with_ctes(SPEC, O.SENTS, _registry_values(), SUPPORT_SQL.format(terms="reg"), body="""
SELECT r.spec, r.axis, CAST(r.side AS INTEGER) AS side, CAST(r.pos AS INTEGER) AS pos, r.term, s.n_sentences
FROM reg r JOIN support s ON s.term = r.term"""))
def q_spec_parse(spark, sf_dir):
    """B1: the term-list text boxes of every registry spec parsed back to terms, with corpus support."""
    parsed = SO.parse_term_text(SO.prefill_text(_registry_terms(spark), n=None))
    return FL.term_support(spark, sf_dir, parsed.select("spec", "axis", "side", "pos", "term"))


LONG = FL.long_spec()


@register("spec_limit", O.with_ctes(SPEC, O.SENTS, _registry_values(), O.spec_values(LONG, "long_terms"), """
every AS (SELECT spec, axis, side, pos, term FROM reg UNION ALL SELECT spec, axis, side, pos, term FROM long_terms)""",
    SUPPORT_SQL.format(terms="every"), body="""
SELECT r.spec, r.axis, CAST(r.side AS INTEGER) AS side, CAST(r.pos AS INTEGER) AS pos, r.term, s.n_sentences
FROM every r JOIN support s ON s.term = r.term WHERE r.pos < 50"""))
def q_spec_limit(spark, sf_dir):
    """The first 50 terms of every registry list and of a list of 64, with corpus support."""
    cols = ["spec", "axis", "side", "pos", "term"]
    lim = SM.limit_lists(_registry_terms(spark).select(*cols).unionByName(SP.spec_terms(spark, LONG).select(*cols)))
    return FL.term_support(spark, sf_dir, lim.select(*cols))


USPEC = FL.unbalanced_spec()


@register("spec_balance", O.with_ctes(SPEC, O.SENTS, O.spec_values(USPEC, "uspec"), """
sz AS (SELECT spec, axis, side, count(*) AS n FROM uspec GROUP BY ALL),
mn AS (SELECT spec, axis, min(n) AS m FROM sz GROUP BY ALL),
rk AS (SELECT u.*, z.n, mn.m, row_number() OVER (PARTITION BY u.spec, u.axis, u.side
         ORDER BY md5('0|' || u.spec || '|' || u.axis || '|' || u.side || '|' || u.term || '|' || u.pos)) AS r
       FROM uspec u JOIN sz z ON z.spec = u.spec AND z.axis = u.axis AND z.side = u.side
       JOIN mn ON mn.spec = u.spec AND mn.axis = u.axis),
bal AS (SELECT spec, axis, CAST(side AS INTEGER) AS side,
               CAST(CASE WHEN n = m THEN pos ELSE r - 1 END AS INTEGER) AS pos, term FROM rk WHERE n = m OR r <= m)""",
  SUPPORT_SQL.format(terms="bal"), body="""
SELECT b.*, s.n_sentences FROM bal b JOIN support s ON s.term = b.term"""))
def q_spec_balance(spark, sf_dir):
    """Lists of unequal length sampled to the shorter length (seeded), with corpus support."""
    bal = SM.balance_lists(SP.spec_terms(spark, USPEC))
    return FL.term_support(spark, sf_dir, bal.select("spec", "axis", "side", "pos", "term"))


def _spec_rows_sql(extra_where: str = "") -> str:
    return f"""
spec_rows AS (
  SELECT r.spec, any_value(r.label) AS label, any_value(r.type) AS type, count(*) AS n_terms,
         CAST(sum(CASE WHEN s.n_sentences > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_terms_seen,
         CAST(sum(s.n_sentences) AS BIGINT) AS n_term_sentences
  FROM reg r JOIN support s ON s.term = r.term {extra_where} GROUP BY r.spec)"""


def _spec_rows(spark, sf_dir):
    specs = SP.registry_specs(spark)
    sup = FL.term_support(spark, sf_dir, _registry_terms(spark))
    agg = sup.groupBy("spec").agg(F.count(F.lit(1)).alias("n_terms"),
                                  F.sum((F.col("n_sentences") > 0).cast("long")).alias("n_terms_seen"),
                                  F.sum("n_sentences").cast("long").alias("n_term_sentences"))
    return specs.select(F.col("tag").alias("spec"), "label", "type").join(agg, "spec")


@register("spec_by_label", O.with_ctes(SPEC, O.SENTS, _registry_values(), SUPPORT_SQL.format(terms="reg"),
                                       _spec_rows_sql(), body="""
SELECT label, spec, type, n_terms, n_terms_seen, n_term_sentences FROM spec_rows"""))
def q_spec_by_label(spark, sf_dir):
    """A3: display label -> spec tag, with each spec's corpus support."""
    labels = SP.registry_specs(spark).select("label")
    return (SP.spec_by_label(SP.registry_specs(spark), labels).select("label", F.col("tag").alias("spec"), "type")
            .join(_spec_rows(spark, sf_dir).drop("label", "type"), "spec")
            .select("label", "spec", "type", "n_terms", "n_terms_seen", "n_term_sentences"))


@register("specs_by_type", O.with_ctes(SPEC, O.SENTS, _registry_values(), SUPPORT_SQL.format(terms="reg"),
                                       _spec_rows_sql("WHERE r.type = 'custom'"), body="""
SELECT spec, type, n_terms, n_terms_seen, n_term_sentences FROM spec_rows"""))
def q_specs_by_type(spark, sf_dir):
    """A5: the custom specs of the registry (kind filter), with corpus support."""
    custom = SP.registry_specs(spark, kind="custom").select(F.col("tag").alias("spec"))
    return (_spec_rows(spark, sf_dir).join(custom, "spec", "left_semi")
            .select("spec", "type", "n_terms", "n_terms_seen", "n_term_sentences"))


@register("spec_name", O.with_ctes(SPEC, O.SENTS, _registry_values(), SUPPORT_SQL.format(terms="reg"),
                                   _spec_rows_sql(), O.spec_names_cte("names", "reg"), body="""
SELECT r.spec, n.bias_name, r.n_terms_seen, r.n_term_sentences FROM spec_rows r JOIN names n ON n.spec = r.spec"""))
def q_spec_name(spark, sf_dir):
    """The name of every registry spec, with its corpus support."""
    return (_spec_rows(spark, sf_dir).join(GN.spec_names(_registry_terms(spark)), "spec")
            .select("spec", "bias_name", "n_terms_seen", "n_term_sentences"))


@register("att_variants", O.with_ctes(SPEC, O.SENTS, _registry_values(), """
variants AS (SELECT DISTINCT spec, v AS att_variant FROM (
  SELECT spec, unnest([term, replace(term, ' ', '-'), replace(term, ' ', '')]) AS v FROM reg WHERE axis = 'attribute'))""",
  SUPPORT_SQL.format(terms="(SELECT att_variant AS term FROM variants)"), body="""
SELECT v.spec, v.att_variant, s.n_sentences FROM variants v JOIN support s ON s.term = v.att_variant"""))
def q_att_variants(spark, sf_dir):
    """Spelling variants of every registry attribute, with corpus support of each spelling."""
    v = BK.att_variants(_registry_terms(spark))
    return FL.term_support(spark, sf_dir, v, term_col="att_variant").select("spec", "att_variant", "n_sentences")


@register("term_pairs", O.with_ctes(SPEC, *PAIRS_CTES, """
tp AS (SELECT a.spec, CAST(a.pos AS INTEGER) AS pos, a.term AS term_0, b.term AS term_1,
              least(a.term, b.term) || '/' || greatest(a.term, b.term) AS pair_key
       FROM spec_terms a JOIN spec_terms b ON a.spec = b.spec AND a.pos = b.pos
       WHERE a.axis = 'group' AND b.axis = 'group' AND a.side = 0 AND b.side = 1)""", body="""
SELECT tp.*, count(p.pair_id) AS n_pairs FROM tp LEFT JOIN pairs p ON p.spec = tp.spec
  AND least(p.grp_term_1, p.grp_term_2) || '/' || greatest(p.grp_term_1, p.grp_term_2) = tp.pair_key
GROUP BY ALL"""))
def q_term_pairs(spark, sf_dir):
    """Index-paired group terms with their pair key and the mined pairs of each key."""
    from stereoscope.functions.keys import unordered_pair_key
    n = (_pairs(spark, sf_dir).groupBy("spec", unordered_pair_key("grp_term_1", "grp_term_2").alias("pair_key"))
         .agg(F.count(F.lit(1)).alias("n_pairs")))
    return (MI.term_pairs(FL.spec_table(spark)).join(n, ["spec", "pair_key"], "left")
            .withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)).cast("long")))


@register("gen_plan_cross", O.with_ctes(SPEC, *PAIRS_CTES, body="""
SELECT g.spec, g.term AS grp_term, a.term AS att_term, count(p.pair_id) AS n_mined
FROM spec_terms g JOIN spec_terms a ON a.spec = g.spec AND g.axis = 'group' AND a.axis = 'attribute'
LEFT JOIN pairs p ON p.spec = g.spec AND p.grp_term_1 = g.term AND p.att_term = a.term
GROUP BY ALL"""))
def q_gen_plan_cross(spark, sf_dir):
    """C6 full-cross form: every (group term, attribute term) of the spec with its mined sentences."""
    n = _pairs(spark, sf_dir).groupBy("spec", F.col("grp_term_1").alias("grp_term"), "att_term") \
        .agg(F.count(F.lit(1)).alias("n_mined"))
    return (GN.gen_plan_cross(FL.spec_table(spark)).join(SP.bounded(FL.materialize(n)), ["spec", "grp_term", "att_term"], "left")
            .withColumn("n_mined", F.coalesce("n_mined", F.lit(0)).cast("long")))


@register("display_text", O.with_ctes(SPEC, *FULL_CTES, DISPLAY_CTE, body="""
SELECT pair_id, model,
  replace(list_reduce(list_prepend({'l': NULL, 'r': NULL}, refs_list),
                      lambda acc, p: CASE WHEN p.l IS NULL THEN acc WHEN instr(acc, '[R]') > 0
                                          THEN substr(acc, 1, instr(acc, '[R]') - 1) || p.l || '/' || p.r || substr(acc, instr(acc, '[R]') + 3)
                                          ELSE acc END, template),
          '[T]', '[' || split_part("Groups", '/', 1) || '&#47;' || split_part("Groups", '/', 2) || ']') AS display_text
FROM display"""))
def q_display_text(spark, sf_dir):
    """The display string of every scored pair (most probable variant first)."""
    d = _display(spark, sf_dir)
    return d.select("pair_id", "model", TX.display_text(F.col("template"), F.col("grp_refs"), F.col("Groups"))
                    .alias("display_text"))


# ---------------------------------------------------------------- a model trained on other text
HELD_OUT = [c.replace("FROM documents", "FROM conversations") if "corpus_bi AS" in c else c for c in O.pipeline(SPEC, "scored")]


@register("stereotype_score_held_out", O.with_ctes(SPEC, *HELD_OUT, body=ATT_SCORES_SQL))
def q_stereotype_score_held_out(spark, sf_dir):
    """The flagship's scores with a language model that has not seen the documents: trained on the conversations."""
    return M.attribute_scores(FL.scored_pairs(spark, sf_dir, lm=FL.held_out_model(spark, sf_dir)))


# ---------------------------------------------------------------- repeated terms, reference words, spellings
REP = FL.repeated_spec()


@register("repeated_terms", O.with_ctes(REP, *[
    # the pairs are numbered here, so nothing rests on the key under test
    c.replace(O.PAIR_ID_SQL, "row_number() OVER () AS pair_id").replace("pairs AS (", "pairs AS MATERIALIZED (", 1) for c in O.pipeline(REP, "scored")], body="""
SELECT doc_id, sent_pos, grp_side, grp_pos, att_side, att_pos, grp_term_1, grp_term_2, att_term, label_1, r0, r1, stereotyped FROM scored"""))
def q_repeated_terms(spark, sf_dir):
    """A term on both sides: every place of it makes its own pair with its own scores."""
    return FL.scored_pairs(spark, sf_dir, REP).select(
        "doc_id", "sent_pos", "grp_side", "grp_pos", "att_side", "att_pos", "grp_term_1", "grp_term_2", "att_term", "label_1", "r0", "r1", "stereotyped")


REF_PAIRS = O.pipeline(SPEC, "pairs") + [O.swapped_cte(FL.REF_WORDS)]


@register("reference_words", O.with_ctes(SPEC, *REF_PAIRS, O.templ_cte("swapped"), body="""
SELECT t.pair_id, s.alt_sentence, t.template, t.grp_refs, t.grp_refs_rev FROM templ t JOIN swapped s ON s.pair_id = t.pair_id"""))
def q_reference_words(spark, sf_dir):
    """C10 with reference words swapped along with the group term, E4-E6 on real references, H6's order of them."""
    p = MI.counterfactual_pairs(FL.mined(spark, sf_dir), FL.spec_table(spark), ref_words=FL.REF_WORDS)
    t = TP.template_refs(p)
    back = F.transform("grp_refs", lambda r: F.struct(r["r"].alias("l"), r["l"].alias("r")))
    return t.select("pair_id", "alt_sentence", "template", TP.refs_text(F.col("grp_refs")).alias("grp_refs"), TP.refs_text(back).alias("grp_refs_rev"))


REF_SCORED = [x for c in O.pipeline(SPEC, "scored") for x in ([c.replace("pairs AS (", "plain_pairs AS (", 1), O.swapped_cte(FL.REF_WORDS, "plain_pairs", "pairs")]
                                                              if c.strip().startswith("pairs AS (") else [c])]


@register("reference_display", O.with_ctes(SPEC, *REF_SCORED, *FULL_CTES[-2:], DISPLAY_CTE, body="""
SELECT pair_id, "Groups", "Sentence", "Alternative", grp_refs,
  replace(list_reduce(list_prepend({'l': NULL, 'r': NULL}, refs_list),
                      lambda acc, p: CASE WHEN p.l IS NULL THEN acc WHEN instr(acc, '[R]') > 0
                                          THEN substr(acc, 1, instr(acc, '[R]') - 1) || p.l || '/' || p.r || substr(acc, instr(acc, '[R]') + 3)
                                          ELSE acc END, template),
          '[T]', '[' || split_part("Groups", '/', 1) || '&#47;' || split_part("Groups", '/', 2) || ']') AS display_text
FROM display"""))
def q_reference_display(spark, sf_dir):
    """H6 and E8 on real references: pairs whose reference words were swapped too, scored, ordered and shown."""
    st = FL.spec_table(spark)
    lp = FL.materialize(PR.pair_labels(MI.counterfactual_pairs(FL.mined(spark, sf_dir), st, ref_words=FL.REF_WORDS), st))
    d = DP.display_pairs(FL.scored_full(spark, sf_dir, scored=FL.scored_pairs(spark, sf_dir, lp=lp)))
    return d.select("pair_id", "Groups", "Sentence", "Alternative", TP.refs_text(F.col("grp_refs")).alias("grp_refs"),
                    TX.display_text(F.col("template"), F.col("grp_refs"), F.col("Groups")).alias("display_text"))


SPELLED = FL.spelled_spec()


@register("spelling_repair", O.with_ctes(SPELLED, *O.pipeline(SPELLED, "pairs"), """
joined AS (SELECT * REPLACE (replace(sentence, 'in the', 'inthe') AS sentence, replace(alt_sentence, replace(att_term, '-', ' '), replace(replace(att_term, '-', ''), ' ', '')) AS alt_sentence)
           FROM (SELECT * FROM pairs UNION ALL SELECT * REPLACE ('in-the' AS att_term) FROM pairs))""",
    O.templ_cte("joined"), body="SELECT t.pair_id, t.template, t.grp_refs FROM templ t"))
def q_spelling_repair(spark, sf_dir):
    """E5: attributes of two words written without their blank or dash."""
    p = MI.counterfactual_pairs(FL.mined(spark, sf_dir, SPELLED), FL.spec_table(spark, SPELLED))
    p = p.unionByName(p.withColumn("att_term", F.lit("in-the")))
    solid = F.replace(F.replace("att_term", F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    p = (p.withColumn("sentence", F.replace("sentence", F.lit("in the"), F.lit("inthe")))
         .withColumn("alt_sentence", F.replace("alt_sentence", F.replace("att_term", F.lit("-"), F.lit(" ")), solid)))
    return TP.template_refs(p).select("pair_id", "template", TP.refs_text(F.col("grp_refs")).alias("grp_refs"))
