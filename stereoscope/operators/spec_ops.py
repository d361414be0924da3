"""Spec operators on term-list text: parse comma text (B1), and the prefill text that
the parse reads back (B4 + join). Balancing (B3) and limiting (B4) live in
``sampling``; naming (B5) in ``generation``; pairing (B6) in ``mining``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P


def parse_term_text(texts: DataFrame) -> DataFrame:
    """B1: (spec, axis, side, text) -> spec_terms. Split on ',', strip spaces only, drop
    empties; no lower-casing, no dedupe."""
    parts = F.filter(F.transform(F.split(F.col("text"), ","), lambda x: F.btrim(x, F.lit(" "))),
                     lambda x: F.length(x) > 0)
    return (texts.select("spec", "axis", "side", F.posexplode(parts).alias("pos", "term"))
            .select("spec", "axis", F.col("side").cast("int").alias("side"), F.lit(None).cast("string")
                    .alias("side_name"), F.col("pos").cast("int").alias("pos"), "term"))


def prefill_text(spec_terms: DataFrame, n: int | None = P.PREFILL_TERMS) -> DataFrame:
    """The four text boxes of a selected spec: first ``n`` terms (None: all) of each list joined by ', '."""
    item = F.struct("pos", "term")
    items = F.array_sort(F.collect_list(item if n is None else F.when(F.col("pos") < n, item)))
    return (spec_terms.groupBy("spec", "axis", "side")
            .agg(F.array_join(F.transform(items, lambda x: x["term"]), ", ").alias("text")))
