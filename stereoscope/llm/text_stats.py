"""Statistics of whole texts as DataFrame expressions, and a bounded sample of labelled rows.

Words are runs without white space (U+0020, U+0009..U+000D); lines are split at line feeds. A null text
has the statistics of an empty one: all 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, n_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words


def words_of(text: Column) -> Column:
    inner = F.call_function("btrim", text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first included.

    Words and windows are hashed (64 bits). Only where two windows' hashes agree are they sorted with their
    places; each window that has an equal neighbour covers its words once.
    """
    n = F.size(words) - (window - 1)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def equal_neighbours(p: Column) -> Column:
            near = lambda e, i: F.coalesce(e["h"] == F.get(p, i)["h"], F.lit(False))
            return F.array_sort(F.array_compact(F.transform(p, lambda e, i: F.when(near(e, i - 1) | near(e, i + 1), e["i"]))))

        def total(starts: Column) -> Column:
            own = F.transform(starts, lambda a, i: F.coalesce(F.least(F.get(starts, i + 1) - a, F.lit(window)), F.lit(window)))
            return F.aggregate(own, F.lit(0), lambda s, x: s + x)

        return _let(_let(placed, equal_neighbours), total)

    def repeats(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))

    return F.when(n > 1, _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), repeats)).otherwise(F.lit(0)).cast("long")


def base_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_lines``, ``n_chars``, ``n_bang``,
    ``n_upper``, ``n_digits``, ``n_pipes``, ``n_distinct`` (words), and ``n_repeat_words``: all long."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], text.alias("_t"), words_of(text).alias("_w"),
                       F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.lit(SPACES), x)) > 0).alias("_lines"))
    w, t, lines = F.col("_w"), F.col("_t"), F.col("_lines")
    stats = {
        "n_words": F.size(w), "word_chars": F.char_length(t) - n_of(t, *SPACES), "n_symbols": n_of(t, *SYMBOLS), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_lines": F.size(lines), "n_chars": F.char_length(t), "n_bang": n_of(t, "!"), "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")), "n_pipes": n_of(t, "|"),
        "n_distinct": F.size(F.array_distinct(w)), "n_repeat_words": n_repeat_words(w),
    }
    return rows.select(*[F.col(f"`{k}`") for k in keep], *[c.cast("long").alias(n) for n, c in stats.items()])


def transformed() -> dict[str, Column]:
    """Rates of the statistics, on scales that do not follow a text's length."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    log = lambda c: F.log1p(c)
    return {
        "log_words": log(F.col("n_words")), "word_length": F.col("word_chars") / n, "symbols": log(100 * F.col("n_symbols") / chars),
        "pipes": log(100 * F.col("n_pipes") / n), "bangs": log(100 * F.col("n_bang") / n), "upper": F.col("n_upper") / chars, "digits": log(100 * F.col("n_digits") / chars),
        "distinct": F.col("n_distinct") / F.sqrt(n), "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
    }


def training_labels(labels: DataFrame, label: str, allowed: Column, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``bound`` labelled ids (``id_col``, ``y``): those with the smallest hashes, so that the
    sample is the same in every run. Rows without id or label are left out; an id labelled twice counts
    once, with its larger label. The result is small enough to send to every executor."""
    rows = labels.filter(allowed & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return rows
