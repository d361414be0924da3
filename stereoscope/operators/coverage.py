"""Coverage and gap reports over a set of test sentences for a spec.

Input rows: (spec, grp_term_1, grp_term_2, att_term, ...). All counting is a
partial aggregation keyed by term; the spec side of every join is spec-sized
(at most |groups| x |attributes| cells) and broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P
from stereoscope.functions.keys import unordered_pair_key
from stereoscope.session import materialize
from stereoscope.sources.specs import bounded

# FIXED VALUES: coverage messages of the measured tool ({src} = Found / Generated).
MSG_ALL_WITH_GAP = ("**%s %d sentences covering all bias specification attributes, but some attributes are "
                    "underepresented. Generating additional %d sentences is suggested.**")
MSG_ALL = "**%s %d sentences covering all bias specification attributes. Please select model to test.**"
MSG_PARTIAL = "**%s %d sentences covering %d of %d attributes. Please select model to test.**"


def attribute_counts(sentences: DataFrame) -> DataFrame:
    """Sentences per attribute spelling."""
    return sentences.groupBy("spec", "att_term").agg(F.count(F.lit(1)).alias("n"))


def attribute_gaps(sentences: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """D3: per spec attribute (exact spelling, zero counts kept): n and n_gap = max(n) - n.
    A term on both sides is reported on side 0."""
    atts = (spec_terms.where(F.col("axis") == "attribute")
            .groupBy("spec", F.col("term").alias("att_term")).agg(F.min("side").alias("side")))
    counts = attribute_counts(sentences)
    j = atts.join(counts, ["spec", "att_term"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    mx = F.max("n").over(Window.partitionBy("spec"))
    return j.select("spec", "side", "att_term", "n", (mx - F.col("n")).alias("n_gap"))


def gap_total(gaps: DataFrame) -> DataFrame:
    """Total of gap counts per spec (0 when there are none)."""
    return gaps.groupBy("spec").agg(F.coalesce(F.sum("n_gap"), F.lit(0)).cast("long").alias("gap_total"))


def coverage_summary(sentences: DataFrame, spec_terms: DataFrame, generated: bool = False) -> DataFrame:
    """Sentences, distinct attribute spellings covered, spec attribute count, total gap, message."""
    stats = sentences.groupBy("spec").agg(F.count(F.lit(1)).alias("n_sentences"),
                                          F.count_distinct("att_term").alias("n_covered"))
    n_att = (spec_terms.where(F.col("axis") == "attribute").groupBy("spec")
             .agg(F.count(F.lit(1)).alias("total_att_terms")))
    gaps = gap_total(attribute_gaps(sentences, spec_terms))
    j = stats.join(bounded(n_att), "spec").join(gaps, "spec")
    src = F.lit("Generated" if generated else "Found")
    msg = (F.when((F.col("n_covered") >= F.col("total_att_terms")) & (F.col("gap_total") > 0),
                  F.format_string(MSG_ALL_WITH_GAP, src, F.col("n_sentences"), F.col("gap_total")))
           .when(F.col("n_covered") >= F.col("total_att_terms"), F.format_string(MSG_ALL, src, F.col("n_sentences")))
           .otherwise(F.format_string(MSG_PARTIAL, src, F.col("n_sentences"), F.col("n_covered"),
                                      F.col("total_att_terms"))))
    return j.select("spec", "n_sentences", "n_covered", "total_att_terms", "gap_total", msg.alias("message"))


def _own_pair_keys(spec_terms: DataFrame) -> DataFrame:
    """Each group term's own pair key: the first (pos, side) where it occurs wins."""
    g = spec_terms.where(F.col("axis") == "group")
    a = g.where(F.col("side") == 0).select("spec", "pos", F.col("term").alias("t0"))
    b = g.where(F.col("side") == 1).select("spec", "pos", F.col("term").alias("t1"))
    zipped = a.join(b, ["spec", "pos"]).withColumn("pair_key", unordered_pair_key("t0", "t1"))
    occ = (zipped.select("spec", "pos", F.lit(0).alias("side"), F.col("t0").alias("term"), "pair_key")
           .unionByName(zipped.select("spec", "pos", F.lit(1).alias("side"), F.col("t1").alias("term"), "pair_key")))
    first = F.min(F.struct("pos", "side", "pair_key"))
    own = occ.groupBy("spec", "term").agg(first.alias("f")).select("spec", "term", F.col("f.pair_key").alias("own_key"))
    permitted = zipped.select("spec", "pair_key").distinct().withColumn("permitted", F.lit(True))
    return own, permitted


def pair_gaps(sentences: DataFrame, spec_terms: DataFrame, target: int = P.PAIR_GAP_TARGET,
              only_missing: bool = False) -> DataFrame:
    """Per (pair key, attribute): n rows and n_gap = max(0, target - n).

    Cells are every (group term, attribute term) of the spec, repeats included. In a cell,
    a single observed pair key is kept even if not permitted; several keys keep only the
    permitted ones; a cell with nothing kept contributes (own key, attribute, 0).
    """
    own, permitted = _own_pair_keys(spec_terms)
    grp = spec_terms.where(F.col("axis") == "group").select("spec", F.col("pos").alias("gpos"),
                                                            F.col("side").alias("gside"), F.col("term").alias("grp"))
    att = spec_terms.where(F.col("axis") == "attribute").select("spec", F.col("pos").alias("apos"),
                                                                F.col("side").alias("aside"), F.col("term").alias("att"))
    cells = grp.join(bounded(att), "spec").join(bounded(own.withColumnRenamed("term", "grp")), ["spec", "grp"], "left")
    # observed (group term 1, attribute, pair key) counts: a partial aggregation over the sentences, then an array
    # per (group term, attribute); written once, as the size check of the broadcast reads it too
    counts = (sentences.groupBy("spec", F.col("grp_term_1").alias("grp"), F.col("att_term").alias("att"),
                                unordered_pair_key("grp_term_1", "grp_term_2").alias("pair_key"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    # a null key (both terms null) is no observed one
    seen = (counts.where(F.col("pair_key").isNotNull()).join(bounded(permitted), ["spec", "pair_key"], "left")
            .groupBy("spec", "grp", "att").agg(F.collect_list(F.struct("pair_key", F.col("cnt").cast("long").alias("cnt"), "permitted")).alias("keys")))
    j = cells.join(bounded(materialize(seen)), ["spec", "grp", "att"], "left")
    kept = F.filter("keys", lambda k: (F.size("keys") == 1) | F.coalesce(k["permitted"], F.lit(False)))
    none = F.array(F.struct(F.col("own_key").alias("pair_key"), F.lit(0).cast("long").alias("cnt")))
    mine = F.transform(kept, lambda k: F.struct(k["pair_key"].alias("pair_key"), k["cnt"].alias("cnt")))
    rows = j.select("spec", "att", F.explode(F.when(F.size(kept) > 0, mine).otherwise(none)).alias("r")).select("spec", "att", "r.*")
    out = (rows.groupBy("spec", "pair_key", F.col("att").alias("att_term")).agg(F.sum("cnt").cast("long").alias("n"))
           .withColumn("n_gap", F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("n")).cast("long")))
    return out.where(F.col("n_gap") > 0) if only_missing else out
