"""Generation planning as tables: targets, a seeded request plan, prompt text for
any batch text-generation job, downsampling and the generation record.

The outside text generator itself is not called; mining (operators/mining.py)
fills the role of accepted generations, and the prompt table is the hand-off
point to a batch LM job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.keys import dashed, seeded_int, seeded_rank, url_safe_md5_b64
from stereoscope.operators.mining import accepts
from stereoscope.operators.sampling import top_n_by_rank
from stereoscope.session import materialize
from stereoscope.sources.specs import bounded


def gen_targets(spec_terms: DataFrame, gaps: DataFrame | None = None, per_attribute: int = 5) -> DataFrame:
    """Wanted sentences per attribute: a constant, or the gap counts (side 1 overrides
    side 0 for the same key); lookup by exact spelling, then the dashed spelling, else 0."""
    atts = spec_terms.where(F.col("axis") == "attribute").select("spec", "side", "pos", F.col("term").alias("att_term"))
    if gaps is None:
        return atts.withColumn("n_target", F.lit(per_attribute).cast("long"))
    w = Window.partitionBy("spec", "att_term").orderBy(F.desc("side"))
    g = (gaps.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
         .select("spec", F.col("att_term").alias("k"), F.col("n_gap").cast("long").alias("n")))
    exact = g.select("spec", F.col("k").alias("att_term"), F.col("n").alias("n_exact"))
    dash = g.select("spec", F.col("k").alias("att_dash"), F.col("n").alias("n_dash"))
    return (atts.join(exact, ["spec", "att_term"], "left")
            .withColumn("att_dash", dashed("att_term")).join(dash, ["spec", "att_dash"], "left")
            .select("spec", "side", "pos", "att_term",
                    F.coalesce("n_exact", "n_dash", F.lit(0)).cast("long").alias("n_target")))


def _term_arrays(spec_terms: DataFrame) -> DataFrame:
    """Per spec: group lists by side (in position order) and the attribute list (both sides)."""
    def ordered(cond):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("side", "pos", "term")))),
                           lambda x: x["term"])
    g, a = F.col("axis") == "group", F.col("axis") == "attribute"
    return spec_terms.groupBy("spec").agg(
        ordered(g & (F.col("side") == 0)).alias("g0"), ordered(g & (F.col("side") == 1)).alias("g1"),
        ordered(g).alias("g_all"), ordered(a).alias("a_all"))


def gen_plan(targets: DataFrame, spec_terms: DataFrame, seed: int = 0) -> DataFrame:
    """Per attribute with n_target > 0, rounds of two requests (one random term of each
    group list, with its index partner) until n_target * 5 requests are reached; a round is always
    whole, so an odd number is passed by one. Seeded picks."""
    arrs = bounded(_term_arrays(spec_terms))
    t = targets.where(F.col("n_target") > 0).join(arrs, "spec")
    n_req = F.col("n_target") * P.GEN_ROUNDS_PER_TARGET
    t = t.withColumn("round", F.explode(F.sequence(F.lit(0), ((n_req + 1) / 2).cast("int") - 1)))
    t = t.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    t = t.withColumn("request", F.col("round") * 2 + F.col("side"))
    own = F.when(F.col("side") == 0, F.col("g0")).otherwise(F.col("g1"))
    other = F.when(F.col("side") == 0, F.col("g1")).otherwise(F.col("g0"))
    idx = F.pmod(seeded_int(seed, "spec", "att_term", "round", "side"), F.size(own))
    return t.select("spec", "att_term", "round", "side", "request",
                    F.element_at(own, (idx + 1).cast("int")).alias("grp_term"),
                    F.element_at(other, (idx + 1).cast("int")).alias("partner"))


REQUEST = ["spec", "att_term", "round", "side", "request"]


def _asked(requests: DataFrame, answers, tries: int, ahead: int) -> DataFrame:
    """``requests`` with ``sentence`` (the first accepted answer; null if none of the tries was), ``accepted`` and ``n_tries``."""
    pending, found = requests, []
    for t in range(0, tries, ahead):
        asks = pending.withColumn("try", F.explode(F.sequence(F.lit(t), F.lit(min(t + ahead, tries) - 1))))
        good = answers(asks).where(accepts("sentence", "grp_term", "att_term"))
        found.append(materialize(good.groupBy(*REQUEST).agg(F.min("try").alias("_try"), F.min_by("sentence", "try").alias("sentence"))))
        if t + ahead < tries:
            pending = materialize(pending.join(found[-1].select(*REQUEST), REQUEST, "left_anti"))
            if pending.isEmpty():
                break
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    out = requests.join(best, REQUEST, "left")
    return out.withColumn("accepted", F.col("_try").isNotNull()).withColumn("n_tries", F.coalesce(F.col("_try") + 1, F.lit(tries)).cast("long")).drop("_try")


def fill_to_targets(targets: DataFrame, spec_terms: DataFrame, answers, seed: int = 0, tries: int = P.GEN_TRIES, ahead: int = 1) -> dict[str, DataFrame]:
    """C6 with retries: ask in rounds until every attribute has its target.

    ``answers(requests)`` returns the rows of ``requests`` (columns of ``gen_plan`` and ``try``) that got an answer, with
    ``sentence``: an outside generator's batch job, or ``mining.corpus_answers``. A request is asked up to ``tries`` times
    until an answer is accepted (C4), ``ahead`` tries at a time. An attribute's rounds, of two requests each, go on until
    its target is reached or it had 5 requests per wanted sentence.

    All attributes are asked together. A step asks the rounds that an attribute still lacks if every request is accepted, or as
    many as it had so far, whichever are more; so there are few steps. Rounds after the one that reached the target count
    as not asked: results are those of asking round by round. Each step's answers are kept by a checkpoint.

    Returns ``sentences`` (accepted, at most the target per attribute, by seeded rank), ``requests`` (each that counts)
    and ``report``: per attribute ``n_target``, ``n_requests``, ``n_tries``, ``n_accepted`` and ``n_unmet``.
    """
    want = targets.groupBy("spec", "att_term").agg(F.max("n_target").alias("n_target"))
    plan = materialize(gen_plan(want, spec_terms, seed))
    rounds = plan.groupBy("spec", "att_term").agg((F.max("round") + 1).alias("_rounds"))
    key, zero = ["spec", "att_term"], F.lit(0).cast("long")
    state = materialize(want.join(rounds, key, "left").select(*key, "n_target", F.coalesce("_rounds", zero).cast("long").alias("_rounds"),
                                                              zero.alias("_had"), zero.alias("_got")))
    done = None
    while True:
        lack = F.ceil((F.col("n_target") - F.col("_got")) / 2)
        until = F.when(F.col("_got") < F.col("n_target"), F.least("_rounds", F.col("_had") + F.greatest(lack, "_had"))).otherwise(F.col("_had"))
        ask = materialize(state.withColumn("_until", until))
        if ask.where(F.col("_until") > F.col("_had")).isEmpty():
            break
        now = plan.join(ask.select(*key, "_had", "_until"), key).where((F.col("round") >= F.col("_had")) & (F.col("round") < F.col("_until"))).drop("_had", "_until")
        got = materialize(_asked(materialize(now), answers, tries, ahead))
        done = got if done is None else done.unionByName(got)
        more = got.groupBy(*key).agg(F.sum(F.col("accepted").cast("long")).alias("_more"))
        state = materialize(ask.join(more, key, "left").select(*key, "n_target", "_rounds", F.col("_until").alias("_had"), (F.col("_got") + F.coalesce("_more", zero)).alias("_got")))
    if done is None:
        done = plan.withColumn("sentence", F.lit(None).cast("string")).withColumn("accepted", F.lit(False)).withColumn("n_tries", zero)
    # the round in which the target was reached; a round is one small row
    per_round = done.groupBy(*key, "round").agg(F.sum(F.col("accepted").cast("long")).alias("_a"))
    so_far = per_round.withColumn("_sum", F.sum("_a").over(Window.partitionBy(*key).orderBy("round")))
    last = (so_far.join(want, key).where(F.col("_sum") >= F.col("n_target")).groupBy(*key).agg(F.min("round").alias("_last")))
    counted = materialize(done.join(last, key, "left").where(F.col("_last").isNull() | (F.col("round") <= F.col("_last"))).drop("_last"))
    sums = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n_tries").alias("n_tries"), F.sum(F.col("accepted").cast("long")).alias("_got"))
    n = lambda c: F.coalesce(F.col(c), zero).cast("long")
    report = want.join(sums, key, "left").select(*key, n("n_target").alias("n_target"), n("n_requests").alias("n_requests"), n("n_tries").alias("n_tries"),
                                                 F.least(n("_got"), n("n_target")).alias("n_accepted"), F.greatest(n("n_target") - n("_got"), zero).alias("n_unmet"))
    sentences = downsample_to_target(counted.where("accepted"), want, seed, key="request").drop("n_target", "keep_rank", "accepted")
    return {"sentences": sentences, "requests": counted, "report": report}


def gen_plan_cross(spec_terms: DataFrame) -> DataFrame:
    """C6 (full-cross form): every group term with every attribute term of the spec."""
    g = spec_terms.where(F.col("axis") == "group").select("spec", F.col("term").alias("grp_term"))
    a = spec_terms.where(F.col("axis") == "attribute").select("spec", F.col("term").alias("att_term"))
    return g.join(a, "spec")


def _context(arr, seed, salt_cols, k=P.PROMPT_CONTEXT_TERMS):
    keyed = F.transform(arr, lambda t: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), *salt_cols, t)).alias("h"), t.alias("t")))
    picked = F.slice(F.array_sort(keyed), 1, k)
    return F.array_join(F.transform(picked, lambda x: F.concat(F.lit("'"), x["t"], F.lit("'"))), ",")


def gen_prompts(plan: DataFrame, spec_terms: DataFrame, seed: int = 0) -> DataFrame:
    """Instruction text per request with up to 8 seeded context terms of each axis."""
    arrs = bounded(_term_arrays(spec_terms))
    salt = [F.col("spec"), F.col("att_term"), F.col("request").cast("string")]
    j = plan.join(arrs, "spec")
    return j.select("spec", "att_term", "request", "grp_term", "partner",
                    F.format_string(P.GEN_INSTRUCTION, F.col("grp_term"), F.col("att_term"),
                                    _context(F.col("g_all"), seed, salt + [F.lit("g")]),
                                    _context(F.col("a_all"), seed, salt + [F.lit("a")])).alias("instruction"))


def rewrite_prompts(pairs: DataFrame) -> DataFrame:
    """The rewrite request for each pair (system instruction and user prompt)."""
    return pairs.select("pair_id", F.format_string(P.REWRITE_INSTRUCTION, "grp_term_1", "grp_term_2").alias("instruction"),
                        F.format_string(P.REWRITE_PROMPT, "sentence").alias("prompt"))


def fewshot_prompts(requests: DataFrame, shots: DataFrame) -> DataFrame:
    """C7 (few-shot form): 'Keywords: a, b ## Sentence: s ##\\n' per shot, then the request's
    keywords. ``shots``: (spec, att_term, shot_no, k0, k1, sentence)."""
    s = shots.groupBy("spec", "att_term").agg(F.array_sort(F.collect_list(F.struct(
        "shot_no", F.format_string("Keywords: %s, %s ## Sentence: %s ##\n", "k0", "k1", "sentence").alias("x"))))
        .alias("xs"))
    j = requests.join(s, ["spec", "att_term"], "left")
    head = F.coalesce(F.array_join(F.transform("xs", lambda e: e["x"]), ""), F.lit(""))
    return j.select("spec", "att_term", "request",
                    F.concat(head, F.format_string("Keywords: %s, %s ## Sentence: ", "grp_term", "att_term"))
                    .alias("prompt"))


def downsample_to_target(rows: DataFrame, targets: DataFrame, seed: int = 0, key: str = "pair_id") -> DataFrame:
    """Keep at most n_target rows per (spec, attribute) by seeded rank."""
    t = bounded(targets.select("spec", "att_term", "n_target"))
    j = rows.join(t, ["spec", "att_term"])
    return top_n_by_rank(j, ["spec", "att_term"], seeded_rank(seed, key), F.col("n_target"), out="keep_rank")


def spec_names(spec_terms: DataFrame) -> DataFrame:
    """B5: 'g1[0]_g2[0]__a1[0]_a2[0]_<hash>' (spaces -> '-'); hash = URL-safe base64 MD5
    of all terms concatenated in list order g1, g2, a1, a2."""
    order = F.when(F.col("axis") == "group", 0).otherwise(1)
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), "side", "pos", "term")))
    firsts = lambda ax, sd: F.first(F.when((F.col("axis") == ax) & (F.col("side") == sd) & (F.col("pos") == 0),  # noqa
                                           F.col("term")), ignorenulls=True)
    g = spec_terms.groupBy("spec").agg(
        F.array_join(F.transform(items, lambda x: x["term"]), "").alias("full"),
        firsts("group", 0).alias("g1"), firsts("group", 1).alias("g2"),
        firsts("attribute", 0).alias("a1"), firsts("attribute", 1).alias("a2"))
    dash = lambda c: F.translate(F.col(c), " ", "-")
    return g.select("spec", F.concat(dash("g1"), F.lit("_"), dash("g2"), F.lit("__"), dash("a1"), F.lit("_"),
                                     dash("a2"), F.lit("_"), url_safe_md5_b64(F.col("full"))).alias("bias_name"))


def generation_record(pairs: DataFrame, spec_terms: DataFrame, gen_model: str = "corpus-mining",
                      kind: str = "tool", keep: tuple[str, ...] = ()) -> DataFrame:
    """C11: the 14-column record and ``keep`` columns (labels come from F1 on the same row; no row-order alignment).
    ``pairs`` carries template, alt_template, grp_refs, label_1, label_2."""
    from stereoscope.operators.templates import refs_text
    names = bounded(spec_names(spec_terms))
    return pairs.join(names, "spec").select(
        "spec", "pair_id", "sentence", "alt_sentence", F.col("grp_term_1").alias("org_grp_term"), "att_term",
        "template", "alt_template", F.col("grp_term_1").alias("grp_term1"), F.col("grp_term_2").alias("grp_term2"),
        refs_text(F.col("grp_refs")).alias("grp_refs"), "label_1", "label_2",
        F.col("bias_name").alias("bias_spec"), F.lit(kind).alias("type"), F.lit(gen_model).alias("gen_model"), *keep)
