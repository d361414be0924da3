"""Templates with reference marks from a sentence and its rewrite (E4-E6), as
staged Column expressions: s_tok, r_tok, z, toks, refs, template. No UDF.

Tokeniser subset (documented, not a full word tokeniser): space-separate
, ; : @ # $ % & ? ! ( ) [ ] { } < > " and '--', '...'; split off a final '.';
split contractions n't 's 'm 'd 'll 're 've; split on spaces. Detokenise: no
space before , . ; : ? ! % ) ] } or a contraction, none after ( [ {.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.text import mask_term

# FIXED VALUES: tokeniser and detokeniser rules of the subset (Java regex).
TOKENISE_RULES = (
    (r"([,;:@#$%&?!()\[\]{}<>\"])", " $1 "),
    (r"(--|\.\.\.)", " $1 "),
    (r"([^.])\.([\s\"')\]}]*)$", "$1 .$2"),
    (r"(?i)(\w)(n't)\b", "$1 $2"),
    (r"(?i)(\w)('s|'m|'d|'ll|'re|'ve)\b", "$1 $2"),
)
DETOKENISE_RULES = (
    (r" ([,.;:?!%)\]}])", "$1"),
    (r"(?i) (n't|'s|'m|'d|'ll|'re|'ve)\b", "$1"),
    (r"([(\[{]) ", "$1"),
)


def tokenize(s: Column) -> Column:
    for pat, rep in TOKENISE_RULES:
        s = F.regexp_replace(s, pat, rep)
    return F.filter(F.split(F.trim(s), " +"), lambda t: t != "")


def detokenize(tokens: Column) -> Column:
    s = F.array_join(tokens, " ")
    for pat, rep in DETOKENISE_RULES:
        s = F.regexp_replace(s, pat, rep)
    return s


def orient(df: DataFrame) -> DataFrame:
    """Target pair = (term 1, term 2) if term 1 is a substring of the sentence, else
    (term 2, term 1) if term 2 is; rows with neither get a null pair (``template_rejects``)."""
    low = F.lower("sentence")
    t1_in = F.instr(low, F.lower("grp_term_1")) > 0
    t2_in = F.instr(low, F.lower("grp_term_2")) > 0
    return (df.withColumn("tw0", F.when(t1_in, F.col("grp_term_1")).when(t2_in, F.col("grp_term_2")))
            .withColumn("tw1", F.when(t1_in, F.col("grp_term_2")).when(t2_in, F.col("grp_term_1"))))


def spelling_repair(sentence: Column, rewrite: Column, att: Column) -> tuple[Column, Column]:
    """E5: dash attribute: its dash-less form in the sentence -> spaced form; spaced attribute:
    its space-less form in the rewrite -> spaced form."""
    dashless = F.replace(att, F.lit("-"), F.lit(""))
    spaced = F.replace(att, F.lit("-"), F.lit(" "))
    s = F.when((F.instr(att, "-") > 0) & (F.length(dashless) > 0), F.replace(sentence, dashless, spaced)) \
        .otherwise(sentence)
    nospace = F.replace(att, F.lit(" "), F.lit(""))
    r = F.when((F.instr(att, " ") > 0) & (F.instr(rewrite, nospace) > 0), F.replace(rewrite, nospace, att)) \
        .otherwise(rewrite)
    return s, r


def template_refs(df: DataFrame) -> DataFrame:
    """E4-E6 on (sentence, alt_sentence, grp_term_1, grp_term_2, att_term): adds
    ``template`` (with [T] and [R]) and ``grp_refs`` array<struct<l, r>>; rows that fail
    E4 are dropped (see ``template_rejects``)."""
    d = orient(df).where(F.col("tw0").isNotNull())
    s, r = spelling_repair(F.col("sentence"), F.col("alt_sentence"), F.col("att_term"))
    d = (d.withColumn("s_tok", tokenize(mask_term(s, F.col("tw0"), "*")))
         .withColumn("r_tok", tokenize(mask_term(r, F.col("tw1"), "*")))
         .withColumn("tw", F.array_distinct(F.transform(
             F.array("tw0", "tw1", F.replace("tw0", F.lit("-"), F.lit("")), F.replace("tw1", F.lit("-"), F.lit(""))),
             lambda x: F.lower(x)))))
    n = F.least(F.size("s_tok"), F.size("r_tok"))
    d = d.withColumn("zs", F.slice("s_tok", 1, n)).withColumn("zr", F.slice("r_tok", 1, n))
    d = d.withColumn("z", F.arrays_zip("zs", "zr"))
    t0, t1 = F.lower("tw0"), F.lower("tw1")

    def tok(e):
        return (F.when(e["zs"] == e["zr"], e["zs"])
                .when(F.array_contains(F.col("tw"), F.lower(e["zs"])), F.lit(P.MARK_TARGET))
                .otherwise(F.lit(P.MARK_REF)))

    def ref(e):
        ls, lr = F.lower(e["zs"]), F.lower(e["zr"])
        left = F.when((ls == "*") & (lr != "*"), t0).otherwise(ls)
        right = F.when((ls != "*") & (lr == "*"), t1).otherwise(lr)
        return F.struct(left.alias("l"), right.alias("r"))

    is_ref = lambda e: (e["zs"] != e["zr"]) & ~F.array_contains(F.col("tw"), F.lower(e["zs"]))
    d = (d.withColumn("template", F.replace(detokenize(F.transform("z", tok)), F.lit("*"), F.lit(P.MARK_TARGET)))
         .withColumn("grp_refs", F.transform(F.filter("z", is_ref), ref)))
    return d.drop("s_tok", "r_tok", "tw", "zs", "zr", "z", "tw0", "tw1")


def template_rejects(df: DataFrame, id_col: str = "pair_id") -> DataFrame:
    return (orient(df).where(F.col("tw0").isNull())
            .select(id_col, F.lit("missing either group term in sentence").alias("reason")))


def refs_text(refs: Column) -> Column:
    """grp_refs as 'l/r;l/r' (scalar form for reports and the oracle)."""
    return F.array_join(F.transform(refs, lambda p: F.concat(p["l"], F.lit("/"), p["r"])), ";")
