"""Sentence mining from a corpus (the re-aimed generator) and keyword acceptance.

Plan shape: documents -> posexplode(split) -> sentences that hold a word key of a
group term and one of an attribute term -> the spec's terms looked up by word key
inside the row (an index of the spec, a constant of the query) -> the exact pattern for
terms that contain a separator -> one row per pair. No shuffle, no join and no
Python on the path, so a frequent term or a hot key costs nothing extra.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.keys import pair_id, seeded_int
from stereoscope.operators.ordinals import ordinal_within
from stereoscope.sources.specs import bounded

# Word key of a sentence chunk: the chunk up to its first '.', ',' or '!'.
_CHUNK_TAIL = r"[.,!][^ ]*"


def split_sentences(docs: DataFrame, lang: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """C9 step 1: (doc_id, sent_pos, sentence): every non-empty trimmed part with a final '.'. ``lang``
    keeps documents of one language, for a spec that names it."""
    if lang is not None:
        docs = docs.where(F.col("lang") == lang)
    s = docs.select(F.col(id_col).alias("doc_id"),
                    F.posexplode(F.split(text_col, P.SENTENCE_SPLIT)).alias("sent_pos", "raw"))
    s = s.select("doc_id", F.col("sent_pos").cast("int").alias("sent_pos"), F.trim("raw").alias("t"))
    return s.where(F.length("t") > 0).select("doc_id", "sent_pos", F.concat("t", F.lit(".")).alias("sentence"))


def sentence_keys(lower_sentence: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(lower_sentence, _CHUNK_TAIL, ""), " "))


def term_keys(spec_terms: DataFrame) -> DataFrame:
    """Spec terms with the lower-cased term, its first-word key, and the exact accept pattern."""
    lt = F.lower("term")
    return spec_terms.select(
        "spec", "axis", "side", "pos", "term",
        F.regexp_replace(F.split(lt, " ").getItem(0), r"[.,!].*$", "").alias("key"),
        (~lt.rlike(P.KEYWORD_FOLLOW)).alias("simple"),
        F.concat(F.lit(r"(^| )\Q"), lt, F.lit(r"\E" + P.KEYWORD_FOLLOW)).alias("accept_re"),
    )


def candidate_words(sentences: DataFrame, cols: list[str]) -> DataFrame:
    """(cols..., ls, key) for each distinct word key of each sentence."""
    low = F.lower("sentence")
    return sentences.select(*cols, low.alias("ls"), F.explode(sentence_keys(low)).alias("key"))


TERM_INDEX = "map<string, array<struct<spec: string, term: string, side: int, pos: int, simple: boolean, accept_re: string>>>"


def _term_index(spec_terms: DataFrame, axis: str) -> tuple[list[str], Column]:
    """The word keys of the spec's terms of one axis, and those terms by key, a constant of the spec's size.

    The spec is a parameter, so its terms are read while the query is made, as a filter's values are."""
    rows = term_keys(spec_terms.where(F.col("axis") == axis)).drop("axis").distinct().orderBy("spec", "side", "pos", "term").collect()
    by_key: dict[str, list[dict]] = {}
    for r in rows:
        by_key.setdefault(r.key, []).append({c: r[c] for c in ("spec", "term", "side", "pos", "simple", "accept_re")})
    return list(by_key), F.from_json(F.lit(json.dumps(by_key)), TERM_INDEX)


# So many word keys are looked for in a sentence by a pattern, before its words are taken apart.
PATTERN_KEYS = 64


def _either_case(key: str) -> str:
    """A pattern of what an ASCII word key is the lower case of: each letter in both cases, and the Kelvin sign for a k."""
    both = lambda c: f"[{c}{c.upper()}" + ("\u212a]" if c == "k" else "]")
    return "".join(both(c) if "a" <= c <= "z" else re.escape(c) for c in key)


def _may_hold(sentence: Column, keys: list[str]) -> Column:
    """Whether one of the word keys is among a sentence's (``sentence_keys`` of its lower case), by a pattern; true where they are too
    many for it. Keys in ASCII are looked for in the sentence as it stands, so that it need not be lower-cased."""
    if len(keys) > PATTERN_KEYS:
        return F.lit(True)
    plain = all(k.isascii() for k in keys)
    any_key = "|".join(_either_case(k) if plain else re.escape(k) for k in keys)
    # with a blank in front each key follows a blank: one character to look for, which is quicker than two cases
    return F.concat(F.lit(" "), sentence if plain else F.lower(sentence)).rlike(f" (?:{any_key})(?:[ .,!]|$)")


def mine_sentences(sentences: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """One row per (spec, sentence, group term, attribute term) found with strict boundaries.

    Output: spec, doc_id, sent_pos, sentence, grp_term, grp_side, grp_pos, att_term, att_side, att_pos.
    """
    groups, group_terms = _term_index(spec_terms, "group")
    attributes, attribute_terms = _term_index(spec_terms, "attribute")
    low = F.lower("sentence")
    # most sentences hold no key of a group term: they go before their words are taken apart
    s = sentences.where(_may_hold(F.col("sentence"), groups) & _may_hold(F.col("sentence"), attributes))
    s = s.select("doc_id", "sent_pos", "sentence", low.alias("ls"), sentence_keys(low).alias("keys"))

    def found(keys: list[str], terms: Column) -> Column:
        # a word is looked up in a set of the keys; a sentence has few that are in it
        all_ = F.flatten(F.transform(F.filter("keys", lambda k: k.isin(keys)), lambda k: terms[k]))
        return F.filter(all_, lambda t: t["simple"] | F.regexp_like(F.col("ls"), t["accept_re"]))

    s = s.select("doc_id", "sent_pos", "sentence", found(groups, group_terms).alias("g"), found(attributes, attribute_terms).alias("a"))
    # outer: else Spark filters by the arrays' sizes too, next to the pattern, and makes the arrays for every sentence
    rows = (s.select("doc_id", "sent_pos", "sentence", F.explode_outer("g").alias("g"), "a")
            .select("doc_id", "sent_pos", "sentence", "g", F.explode_outer("a").alias("a")).where("g.spec = a.spec"))
    return rows.select(F.col("g.spec").alias("spec"), "doc_id", "sent_pos", "sentence",
                       F.col("g.term").alias("grp_term"), F.col("g.side").alias("grp_side"),
                       F.col("g.pos").alias("grp_pos"), F.col("a.term").alias("att_term"),
                       F.col("a.side").alias("att_side"), F.col("a.pos").alias("att_pos"))


def attribute_sentences(sentences: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """(spec, att_term, doc_id, sent_pos, sentence): each sentence that holds an attribute term, with strict boundaries."""
    atts = term_keys(spec_terms.where(F.col("axis") == "attribute").select("spec", "axis", F.lit(0).alias("side"), F.lit(0).alias("pos"), "term").distinct())
    keys = bounded(atts.select("spec", F.col("term").alias("att_term"), "key", "simple", "accept_re"))
    may = _may_hold(F.col("sentence"), sorted(r[0] for r in atts.select("key").distinct().collect()))
    rows = candidate_words(sentences.where(may), ["doc_id", "sent_pos", "sentence"]).join(keys, "key")
    return rows.where(F.col("simple") | F.expr("ls rlike accept_re")).select("spec", "att_term", "doc_id", "sent_pos", "sentence")


def corpus_answers(sentences: DataFrame, spec_terms: DataFrame, seed: int = 0):
    """A generator for ``generation.fill_to_targets`` whose answers are corpus sentences: each try of a request draws, by
    a seeded hash, one of the sentences that hold its attribute. Nothing says that the sentence holds the group term.

    The sentences are numbered per attribute once; a try is a join on the number."""
    numbered = ordinal_within(attribute_sentences(sentences, spec_terms), ["spec", "att_term"], ["doc_id", "sent_pos"], out="_no")
    counts = numbered.groupBy("spec", "att_term").agg(F.count(F.lit(1)).alias("_all"))

    def answers(requests: DataFrame) -> DataFrame:
        drawn = requests.join(counts, ["spec", "att_term"]).withColumn("_no", F.pmod(seeded_int(seed, "spec", "att_term", "request", "try"), F.col("_all")) + 1)
        return drawn.join(numbered, ["spec", "att_term", "_no"]).drop("_no", "_all")

    return answers


def accepts(sentence, grp, att, strict: bool = False) -> Column:
    """C4 as a predicate: the sentence holds both keywords, each followed by one of space . , !

    ``strict=False`` is the measured tool's rule (no left boundary, so 'he' hits 'the ');
    ``strict=True`` adds the left boundary used for mining."""
    left = "(^| )" if strict else ""
    low = F.lower(F.col(sentence) if isinstance(sentence, str) else sentence)

    def pat(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.concat(F.lit(left + r"\Q"), F.lower(c), F.lit(r"\E" + P.KEYWORD_FOLLOW))

    return F.regexp_like(low, pat(grp)) & F.regexp_like(low, pat(att))


def accept_candidates(df: DataFrame, sentence: str = "sentence", grp: str = "grp_term",
                      att: str = "att_term", strict: bool = False) -> DataFrame:
    """C4: keep the rows that pass ``accepts``."""
    return df.where(accepts(sentence, grp, att, strict))


def _replacement_literal(c: Column) -> Column:
    """Escape '$' and '\\' so a term is inserted literally by regexp_replace."""
    return F.regexp_replace(c, r"([$\\])", r"\\$1")


def rewrite_term(sentence: Column, term: Column, partner: Column) -> Column:
    """Replace whole-word ``term`` (case-insensitive) by ``partner``; two passes cover adjacent repeats."""
    pat = F.concat(F.lit(r"(?iu)(^| )\Q"), term, F.lit(r"\E([ .,!])"))
    rep = F.concat(F.lit("$1"), _replacement_literal(partner), F.lit("$2"))
    return F.regexp_replace(F.regexp_replace(sentence, pat, rep), pat, rep)


def term_pairs(spec_terms: DataFrame) -> DataFrame:
    """Group terms paired by index across the two sides, with the unordered pair key."""
    g = spec_terms.where(F.col("axis") == "group")
    a = g.where(F.col("side") == 0).select("spec", "pos", F.col("term").alias("term_0"))
    b = g.where(F.col("side") == 1).select("spec", "pos", F.col("term").alias("term_1"))
    return (a.join(b, ["spec", "pos"])
            .select("spec", "pos", "term_0", "term_1",
                    F.concat_ws("/", F.least("term_0", "term_1"), F.greatest("term_0", "term_1")).alias("pair_key")))


def swap_words(sentence: Column, words: dict[str, str]) -> Column:
    """Reference words swapped in one pass over the sentence's blanks: each word (a final mark stays
    behind it) that is a key becomes its value; a capital first letter stays one."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])

    def swapped(w: Column) -> Column:
        bare = F.regexp_replace(w, r"[.,!?;:]+$", "")
        new = table[F.lower(bare)]
        new = F.when(bare == F.initcap(bare), F.initcap(new)).otherwise(new)
        return F.when(new.isNull(), w).otherwise(F.concat(new, F.substring(w, F.length(bare) + 1, F.length(w))))

    return F.array_join(F.transform(F.split(sentence, " "), swapped), " ")


def counterfactual_pairs(mined: DataFrame, spec_terms: DataFrame, ref_words: dict[str, str] | None = None,
                         rewrites: DataFrame | None = None) -> DataFrame:
    """The alternative sentence with group term 1 replaced by its index partner.

    Output adds grp_term_1, grp_term_2, alt_sentence, pair_id. ``pair_id`` names the spec, the sentence and
    both terms with their places in the lists, so a term on both sides makes two pairs. ``ref_words`` swaps
    words that refer to the group term too (he/she, his/her); ``rewrites`` (pair_id, alt_sentence) are
    supplied rewrites, which win. Rows whose term has no partner (lists of unequal length) are dropped here
    and reported by ``missing_partners``.
    """
    partners = bounded(spec_terms.where(F.col("axis") == "group")
                       .select("spec", (1 - F.col("side")).alias("grp_side"), F.col("pos").alias("grp_pos"),
                               F.col("term").alias("grp_term_2")))
    j = mined.join(partners, ["spec", "grp_side", "grp_pos"])
    alt = rewrite_term(F.col("sentence"), F.lower("grp_term"), F.col("grp_term_2"))
    if ref_words:
        alt = swap_words(alt, ref_words)
    out = j.select(
        "spec", "doc_id", "sent_pos",
        pair_id("spec", "doc_id", "sent_pos", "grp_side", "grp_pos", "grp_term", "att_side", "att_pos", "att_term").alias("pair_id"),
        "sentence", alt.alias("alt_sentence"),
        F.col("grp_term").alias("grp_term_1"), "grp_term_2", "att_term", "grp_side", "grp_pos", "att_side", "att_pos")
    if rewrites is not None:
        given = rewrites.select("pair_id", F.col("alt_sentence").alias("_given"))
        out = (out.join(given, "pair_id", "left")
               .withColumn("alt_sentence", F.coalesce("_given", "alt_sentence")).drop("_given"))
    return out


def missing_partners(mined: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """F3 for mining: mined rows whose group term has no partner at its index on the other
    side (lists of unequal length); an anti join against the size-checked partner table."""
    partners = bounded(spec_terms.where(F.col("axis") == "group")
                       .select("spec", (1 - F.col("side")).alias("grp_side"), F.col("pos").alias("grp_pos")))
    return (mined.join(partners, ["spec", "grp_side", "grp_pos"], "left_anti")
            .select("spec", "doc_id", "sent_pos", "grp_term", "att_term",
                    F.lit("group term has no partner at its index").alias("reason")))
