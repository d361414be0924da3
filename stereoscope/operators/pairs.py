"""Pair labelling (stereotype / anti-stereotype) and its reject report.

Label rule: the attribute's side sets the direction (side 0 -> group 1 is the
stereotype; side 0 wins when a term is on both sides); the direction flips when
``grp_term_1`` is not on group side 0 but is on side 1; a group term on no side
keeps the direction. Attribute lookup treats space and dash as equal; group
lookup is exact. Both lookups are broadcast joins against spec-sized tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.keys import dashed, seeded_int
from stereoscope.sources.specs import bounded


def attribute_sides(spec_terms: DataFrame) -> DataFrame:
    return (spec_terms.where(F.col("axis") == "attribute")
            .groupBy("spec", dashed("term").alias("att_key")).agg(F.min("side").alias("att_dir_side")))


def group_sides(spec_terms: DataFrame) -> DataFrame:
    return (spec_terms.where(F.col("axis") == "group")
            .groupBy("spec", F.col("term").alias("grp_term_1")).agg(F.min("side").alias("grp_dir_side")))


def _with_sides(pairs: DataFrame, spec_terms: DataFrame) -> DataFrame:
    att = bounded(attribute_sides(spec_terms))
    grp = bounded(group_sides(spec_terms))
    return (pairs.withColumn("att_key", dashed("att_term"))
            .join(att, ["spec", "att_key"], "left")
            .join(grp, ["spec", "grp_term_1"], "left")
            .drop("att_key"))


def pair_labels(pairs: DataFrame, spec_terms: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """adds label_1 / label_2. Rows whose attribute is in no list are dropped (see ``pair_rejects``)."""
    j = _with_sides(pairs, spec_terms)
    if not keep_unknown:
        j = j.where(F.col("att_dir_side").isNotNull())
    stereo_first = (F.col("att_dir_side") == 0) == (F.coalesce(F.col("grp_dir_side"), F.lit(0)) == 0)
    return (j.withColumn("label_1", F.when(stereo_first, P.STEREOTYPE).otherwise(P.ANTI_STEREOTYPE))
            .withColumn("label_2", F.when(stereo_first, P.ANTI_STEREOTYPE).otherwise(P.STEREOTYPE))
            .drop("att_dir_side", "grp_dir_side"))


def pair_rejects(pairs: DataFrame, spec_terms: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """one row per failed check: attribute unknown; group term 1 on no side;
    group term 2 not on the side opposite to group term 1."""
    j = _with_sides(pairs, spec_terms)
    g2 = bounded(spec_terms.where(F.col("axis") == "group")
                 .groupBy("spec", F.col("term").alias("grp_term_2")).agg(F.collect_set("side").alias("g2_sides")))
    j = j.join(g2, ["spec", "grp_term_2"], "left")
    reasons = F.array(
        F.when(F.col("att_dir_side").isNull(), F.lit("attribute not in spec")),
        F.when(F.col("grp_dir_side").isNull(), F.lit("group term 1 not in spec")),
        F.when(F.col("grp_dir_side").isNotNull()
               & ~F.coalesce(F.array_contains("g2_sides", 1 - F.col("grp_dir_side")), F.lit(False)),
               F.lit("group term 2 not on the opposite side")))
    return (j.select("spec", id_col, F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason")))


def pair_labels_by_index(pairs: DataFrame, spec_terms: DataFrame, seed: int = 0) -> DataFrame:
    """F2 (older form): group term 2 is the partner at the same index of the other list
    (a seeded pick when that index is missing); direction from the attribute's side,
    reversed when group term 1 is found on side 1. Rows whose group term is in no
    list, or whose attribute is in no list, are dropped (they are F3 rejects)."""
    g = spec_terms.where(F.col("axis") == "group")
    lists = bounded(g.groupBy("spec").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.struct("pos", "term")))),
                    lambda x: x["term"]).alias("l0"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.struct("pos", "term")))),
                    lambda x: x["term"]).alias("l1")))
    att = bounded(attribute_sides(spec_terms))
    j = (pairs.select("spec", "pair_id", "grp_term_1", "att_term").join(lists, "spec")
         .withColumn("att_key", dashed("att_term")).join(att, ["spec", "att_key"]))
    i0 = F.array_position("l0", F.col("grp_term_1"))
    i1 = F.array_position("l1", F.col("grp_term_1"))
    on0 = i0 > 0
    idx = F.when(on0, i0).otherwise(i1)
    other = F.when(on0, F.col("l1")).otherwise(F.col("l0"))
    fallback = F.pmod(seeded_int(seed, "pair_id"), F.size(other)) + 1
    pos = F.when(idx <= F.size(other), idx).otherwise(fallback).cast("int")
    j = j.where((i0 > 0) | (i1 > 0)).withColumn("grp_term_2", F.element_at(other, pos))
    stereo_first = (F.col("att_dir_side") == 0) == on0
    return j.select("spec", "pair_id", "grp_term_1", "grp_term_2", "att_term",
                    F.when(stereo_first, P.STEREOTYPE).otherwise(P.ANTI_STEREOTYPE).alias("label_1"),
                    F.when(stereo_first, P.ANTI_STEREOTYPE).otherwise(P.STEREOTYPE).alias("label_2"))
