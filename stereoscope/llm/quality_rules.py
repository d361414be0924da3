"""Quality rules as a learned decision list.

Sequential covering over labelled documents' statistics: a rule for low quality grows by the threshold
condition with the largest information gain, is pruned on rows set aside, and is kept if it is precise
there; the rows it covers go, and the next rule is grown. Rules are conjunctions of ``statistic > t`` or
``statistic <= t``; the list is emitted as one ordered conditional expression.

Thresholds are quantiles of the training rows. Each row keeps, per statistic, the number of thresholds
below its value, so one grouped count of small integers yields the figures of every possible condition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .text_stats import base_statistics, training_labels, transformed

TRAINING_ROWS = 100_000  # labelled rows that the fit reads at most
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]
MOST_RULES, MOST_CONDITIONS = 12, 3
LEAST_PRECISION, LEAST_COVERED = 0.95, 5
FEW_WORDS, REPEAT_PERCENT = 10, 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Condition:
    name: str
    above: bool
    step: int  # number of the threshold
    threshold: float

    def on_values(self) -> Column:
        c = F.col(self.name)
        return c > self.threshold if self.above else c <= self.threshold

    def on_steps(self) -> Column:
        c = F.col(f"s_{self.name}")
        return c > self.step if self.above else c <= self.step

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)
    precision: float = 0.0

    def on_values(self) -> Column:
        return _all([c.on_values() for c in self.conditions])

    def on_steps(self) -> Column:
        return _all([c.on_steps() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) or "always"


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _gain(p: int, n: int, was_p: int, was_n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(was_p / (was_p + was_n))) if p and was_p else 0.0


def _counts(rows: DataFrame, names: list[str]) -> dict[tuple[str, int], tuple[int, int]]:
    """(statistic, step) -> rows of low and of high quality: a few hundred rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s_{n}").alias("step")) for n in names])).alias("e")
    found = rows.select("y", pairs).groupBy("e.name", "e.step").agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("bad"), F.sum("y").alias("good"))
    return {(r["name"], r["step"]): (r["bad"], r["good"]) for r in found.collect()}


def _best(counts: dict, names: list[str], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, tuple[int, int]]:
    best: tuple[float, Condition | None, tuple[int, int]] = (0.0, None, (0, 0))
    for name in names:
        steps = [counts.get((name, s), (0, 0)) for s in range(len(cuts[name]) + 1)]
        all_p, all_n = (sum(x[i] for x in steps) for i in (0, 1))
        low_p = low_n = 0
        for s, t in enumerate(cuts[name]):
            low_p, low_n = low_p + steps[s][0], low_n + steps[s][1]
            for above, p, n in ((False, low_p, low_n), (True, all_p - low_p, all_n - low_n)):
                if p >= LEAST_COVERED and (g := _gain(p, n, all_p, all_n)) > best[0] + 1e-9:
                    best = (g, Condition(name, above, s, t), (p, n))
    return best


def learn(rows: DataFrame, names: list[str]) -> list[Rule]:
    """Rules from ``rows`` (``names``, ``y`` 1 good or 0 bad, ``grow``). No rows of either class: no rules."""
    asked = [F.percentile_approx(n, QUANTILES, 1000).alias(n) for n in names]
    cuts: dict[str, list[float]] = {n: [] for n in names}
    for r in rows.groupBy("y").agg(*asked).collect():  # two rows
        for n in names:
            cuts[n] = sorted({*cuts[n], *map(float, r[n] or [])})
    steps = [sum(((F.col(n) > t).cast("int") for t in cuts[n]), F.lit(0)).alias(f"s_{n}") for n in names]
    left = staged(rows.select("y", "grow", *steps), "rules")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule, grow = Rule(), left.filter("grow")
        while len(rule.conditions) < MOST_CONDITIONS:
            _, condition, (_, n) = _best(_counts(grow.filter(rule.on_steps()), names), names, cuts)
            if condition is None:
                break
            rule.conditions.append(condition)
            if not n:
                break
        if not rule.conditions:
            break
        # prune: the first conditions that do best on the rows set aside; ties keep the shorter rule
        tried = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        seen = left.filter("not grow").agg(*[F.sum(F.when(t.on_steps() & (F.col("y") == v), 1).otherwise(0)).alias(f"c_{k}_{v}") for k, t in enumerate(tried) for v in (0, 1)]).first()
        held = [(seen[f"c_{k}_0"] or 0, seen[f"c_{k}_1"] or 0) for k in range(len(tried))]
        k = max(range(len(tried)), key=lambda k: ((held[k][0] - held[k][1]) / max(1, sum(held[k])), -k))
        rule, (p, n) = tried[k], held[k]
        rule.precision = p / max(1, p + n)
        if p < LEAST_COVERED or rule.precision < LEAST_PRECISION:
            break
        rules.append(rule)
        left = left.filter(~rule.on_steps())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a row's statistics meet, 0 for none."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.on_values(), F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: id, the base statistics, ``base_failed`` (few words, or many of them repeated),
    ``rule`` (number of the rule met, 0 for none) and ``kept`` (neither).

    Rules are learnt from at most about ``training_rows`` labelled rows that do not fail the base; a third of
    them, by a hash of the id, is set aside for pruning. A null text has no words and fails the base. Without
    labels of both classes there are no rules. Rows without id get no label; rows with one id are judged
    each by its text. An empty table gives no rows.
    """
    rates = transformed()
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = base_statistics(docs, text_col, (id_col,)).select(id_col, *BASE, failed.alias("base_failed"), *[c.cast("double").alias(n) for n, c in rates.items()])
    rows = staged(stats, "statistics")
    known = training_labels(labels, label, F.lit(True), training_rows, id_col)
    train = rows.filter(~F.col("base_failed")).join(F.broadcast(known), id_col).withColumn("grow", F.pmod(F.xxhash64(id_col), F.lit(3)) != 0)
    rule = verdict(learn(train, list(rates)))
    return rows.select(id_col, *BASE, "base_failed", rule.alias("rule"), (~F.col("base_failed") & (rule == 0)).alias("kept"))
