"""Template and text Column expressions (no UDFs).

E1 add_period, E2 mask_term (single regex pass equal to the measured tool's
find-and-splice loop), E3 template_simple, E7 fill_template, E8 display_text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stereoscope.functions import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_quotes(s) -> Column:
    return F.regexp_replace(_c(s), r'^"+|"+$', "")


def add_period(s) -> Column:
    """Append '.' unless the last character is ASCII punctuation; empty stays empty."""
    s = _c(s)
    return F.when((F.length(s) == 0) | s.rlike(P.FINAL_PUNCT_SPARK), s).otherwise(F.concat(s, F.lit(".")))


def mask_term(sentence, term, mark: str = P.MARK_TARGET) -> Column:
    """Strip quotes, add period, then replace each whole-word ``term`` (case-insensitive)
    with ``mark``, keeping one leading space and only the last trailing [ .,!] character."""
    pat = F.concat(F.lit(r"(?iu)(?:^|( ) *)\Q"), F.lower(_c(term)), F.lit(r"\E[ .,!]*(?=[ .,!])"))
    return F.regexp_replace(add_period(strip_quotes(sentence)), pat, F.lit("$1" + mark.replace("$", r"\$")))


def template_term(sentence, term_1, term_2) -> Column:
    """E3 choice: term 1 if it is a (case-insensitive) substring of the sentence, else term 2."""
    return F.when(F.instr(F.lower(_c(sentence)), F.lower(_c(term_1))) > 0, _c(term_1)).otherwise(_c(term_2))


def template_simple(sentence, term_1, term_2) -> Column:
    """Mask whichever group term the sentence contains."""
    return mask_term(sentence, template_term(sentence, term_1, term_2))


def fill_template(template, term, mark: str = P.MARK_TARGET) -> Column:
    """Put ``term`` in every ``mark``."""
    return F.replace(_c(template), F.lit(mark), _c(term))


def display_text(template, refs, groups_rel) -> Column:
    """Replace the first remaining [R] by 'l/r' for each ref in order, then every [T]
    by '[g1&#47;g2]' from the 'g1/g2' groups string."""
    def step(acc, p):
        i = F.instr(acc, P.MARK_REF)
        rep = F.concat(p["l"], F.lit("/"), p["r"])
        return F.when(i > 0, F.overlay(acc, rep, i, F.lit(len(P.MARK_REF)))).otherwise(acc)

    filled = F.aggregate(_c(refs), _c(template), step)
    g = F.split(_c(groups_rel), "/")
    disp = F.concat(F.lit("["), g.getItem(0), F.lit("&#47;"), g.getItem(1), F.lit("]"))
    return F.replace(filled, F.lit(P.MARK_TARGET), disp)
