"""How filters interact: what each removes alone, after others, and in every order.

Every document has the set of filters that it fails, a small bit mask. A coalition of filters removes the
documents whose mask meets it, so the counts per mask give the value of all coalitions (32 for five
filters), and every step of every order is the difference of two coalitions' values.

A filter's Shapley value is fitted: weighted least squares of the coalitions' values on their members,
with the Shapley kernel as weights and the values of all filters adding up to that of the full coalition.
The normal equations depend on the number of filters alone; they are solved once in rational numbers, for
all coalitions as right-hand sides, so a value is an exact linear form of the coalitions' counts.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

MOST = 6  # filters: the result has n! orders per part


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination in rationals; ``right`` has one column per right-hand side."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c] != 0)
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c] != 0:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """``w[f][s]``: the Shapley value of filter f is the sum over coalitions s (bit masks) of ``w[f][s]`` times
    the value of s, the empty one's value being 0.

    Least squares over the proper coalitions with kernel ``(n-1) / (comb(n,|s|) |s| (n-|s|))``, under the
    constraint that the n values add up to the full coalition's; the constraint's multiplier is the last unknown.
    """
    full = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    has = lambda s, f: s >> f & 1
    normal = [[Fraction(sum(k for s, k in kernel.items() if has(s, f) and has(s, g))) for g in range(n)] + [Fraction(1)] for f in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel[s] if s in kernel and has(s, f) else Fraction(0) for s in range(full + 1)] for f in range(n)]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    return solve(normal, right)[:n]


def failures(docs: DataFrame, conditions: dict[str, Column], repeats: str | None, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "lang") -> DataFrame:
    """Rows ``id``, ``part``, ``mask``, ``n``: how many rows of that id and part fail just the filters of the mask.

    Bit k of a mask stands for the k-th name of ``conditions`` (failure conditions over the documents'
    columns; null counts as no failure) and, last, for ``repeats``: the text equals that of a smaller id anywhere in the
    table. Texts are compared by SHA-256. A null id is neither smaller than another nor has it smaller ones.
    Rows with one id and text are counted first; whether a row is its text's first is then looked up by text
    and id, so a text that a third of all rows share is no hot key.
    """
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions.values())), F.lit(0))
    id_, part = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(id_.alias("id"), part.alias("part"), F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    rows = staged(rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "failures")
    if repeats is not None:
        first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
        again = F.col("id").isNotNull() & F.col("_first").isNull()
        rows = rows.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(again, F.lit(1 << len(conditions))).otherwise(F.lit(0)))
    return rows.select("id", "part", "mask", "n")


def coalitions(failed: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Per part: ``of``, an array over all coalitions (index: bit mask) of ``rows`` removed, and of ``good`` and
    ``toxic`` ones among them; and ``total`` rows.

    A document is good (toxic) if a row of ``labels`` with its id says quality 1 (toxic 1).
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    some = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    masks = failed.join(told, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("rows"), some("good"), some("toxic"))
    each = masks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    lost = lambda c: F.sum(F.when(F.col("mask").bitwiseAND(F.col("s")) != 0, F.col(c)).otherwise(F.lit(0))).alias(c)
    values = each.groupBy("part", "s").agg(lost("rows"), lost("good"), lost("toxic"), F.sum("rows").alias("total"))
    # 2**n rows per part
    return values.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "rows", "good", "toxic"))).alias("of"), F.max("total").alias("total"))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], repeats: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley`` (the step's filter's removed, summed over all orders).

    ``conditions`` names the failure conditions by single letters; ``repeats`` names the filter that removes
    texts of smaller ids. Null texts count as empty, a null part as the empty string; parts are those that
    occur, and steps without rows count 0. Labels of ids that do not occur, null labels and null ids change
    nothing; repeated rows count each. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    names = [*conditions, *([repeats] if repeats else [])]
    n = len(names)
    if not 2 <= n <= MOST or any(len(x) != 1 for x in names):
        raise ValueError(f"2 to {MOST} filters with names of one letter")
    full, orders = (1 << n) - 1, factorial(n)
    parts = coalitions(failures(docs, conditions, repeats, id_col, text_col, part_col), labels, n)
    v = lambda s, what="rows": F.element_at("of", (s if isinstance(s, Column) else F.lit(s)) + 1)[what]
    weights = shapley_weights(n)
    base = lcm(*[w.denominator for row in weights for w in row])
    value = [F.call_function("div", sum((F.lit(int(w * base * orders)) * v(s) for s, w in enumerate(row) if w), F.lit(0)), F.lit(base)) for row in weights]
    parts = parts.select("part", "of", "total", F.array(*value).alias("values"), F.array(*[v(1 << k) for k in range(n)]).alias("alone"),
                         F.array(*[v(full) - v(full & ~(1 << k)) for k in range(n)]).alias("unique"))
    place = lambda name: F.instr(F.lit("".join(names)), name)
    bit = lambda name: F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), place(name))
    steps = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("_at", "_name"))
    earlier = F.aggregate(F.transform(F.slice(F.split("filter_order", ""), F.lit(1), F.col("_at")), bit), F.lit(0), lambda a, b: a + b)
    steps = steps.withColumn("_before", earlier).withColumn("_after", F.col("_before") + bit(F.col("_name"))).withColumn("_f", place(F.col("_name")))
    before, after, mine = F.col("_before"), F.col("_after"), lambda c: F.element_at(c, F.col("_f"))
    removed = v(after) - v(before)
    return steps.select("part", "filter_order", (F.col("_at") + 1).alias("step"), (F.col("total") - v(after)).alias("kept"), removed.alias("removed"),
                        (mine("alone") - removed).alias("redundant"), mine("unique").alias("unique_fails"), (v(after, "good") - v(before, "good")).alias("good_lost"),
                        (v(after, "toxic") - v(before, "toxic")).alias("toxic_lost"), mine("values").alias("shapley"))
