"""Quality by a regularised quadratic discriminant.

Each class of labelled documents has a mean and a covariance of its transformed statistics. Covariances
shrink towards the pooled one and its diagonal. A document's score is the logistic function of the
difference of the two Mahalanobis log densities, whose Cholesky factors are computed once and become
constants of one DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, staged
from .text_stats import base_statistics, training_labels, transformed

TRAINING_ROWS = 100_000  # labelled rows that the fit reads at most
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.1
FLOOR = 1e-3  # least variance, in units of the statistic's overall variance


@dataclass
class Model:
    names: list[str]
    centre: np.ndarray
    scale: np.ndarray
    mean: dict[int, np.ndarray]
    inverse: dict[int, np.ndarray]  # of the lower Cholesky factor
    log_det: dict[int, float]
    log_prior: dict[int, float]

    def score(self) -> Column:
        """The probability of label 1, from the columns ``names``."""
        z = [(F.col(n) - float(c)) / float(s) for n, c, s in zip(self.names, self.centre, self.scale)]

        def log_density(k: int) -> Column:
            d = [x - float(m) for x, m in zip(z, self.mean[k])]
            squares = []
            for row in self.inverse[k]:
                y = sum((F.lit(float(a)) * x for a, x in zip(row, d) if abs(a) > 1e-12), F.lit(0.0))
                squares.append(y * y)
            return F.lit(-0.5) * sum(squares, F.lit(0.0)) + F.lit(-0.5 * self.log_det[k] + self.log_prior[k])

        if len(self.mean) < 2:  # no rows of one class: nothing to tell apart
            return F.lit(float(next(iter(self.mean), 0)))
        gap = log_density(0) - log_density(1)
        return 1 / (1 + F.exp(F.least(F.greatest(gap, F.lit(-500.0)), F.lit(500.0))))


def fit(rows: DataFrame, names: list[str]) -> Model:
    """From ``rows`` (``names``, ``y`` 0 or 1): one aggregation of sums and products per class."""
    moments = [F.sum(n).alias(f"s_{n}") for n in names] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    found = {r["y"]: r for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *moments).collect()}  # two rows
    d = len(names)
    n = {k: r["n"] for k, r in found.items()}
    total = max(1, sum(n.values()))
    sums = {k: np.array([r[f"s_{x}"] for x in names], float) for k, r in found.items()}
    prods = {k: np.array([[r[f"p_{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)], float) for k, r in found.items()}
    centre = sum(sums.values(), np.zeros(d)) / total
    whole = sum(prods.values(), np.zeros((d, d))) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(whole), 1e-12))
    scale[scale < 1e-5] = 1.0
    mean, cov = {}, {}
    for k in found:
        raw = sums[k] / n[k]
        mean[k] = (raw - centre) / scale
        cov[k] = (prods[k] / n[k] - np.outer(raw, raw)) / np.outer(scale, scale)
    pooled = sum((n[k] * cov[k] for k in cov), np.zeros((d, d))) / total
    inverse, log_det, prior = {}, {}, {}
    for k in cov:
        c = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(d)
        low = np.linalg.cholesky(c)
        inverse[k] = np.linalg.inv(low)
        log_det[k] = 2 * float(np.log(np.diag(low)).sum())
        prior[k] = float(np.log(n[k] / total))
    return Model(names, centre, scale, mean, inverse, log_det, prior)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    stats = base_statistics(docs, text_col, (id_col,))
    return stats.select(id_col, *[c.cast("double").alias(n) for n, c in transformed().items()])


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, label: str = "quality", threshold: float = 0.3,
           id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: id, ``held_out`` (crc32 of the id modulo ``folds`` is ``held``), ``score``,
    ``predicted``.

    Only labels of rows that are not held out are learnt, from at most about ``training_rows`` of them.
    Null and empty texts score as texts whose statistics are all 0. Without labelled rows every score is 0;
    with rows of one class alone it is that class. An empty table gives no rows.
    """
    rows = staged(features(docs, id_col, text_col), "statistics")
    names = list(transformed())
    known = training_labels(labels, label, fold(id_col, folds) != held, training_rows, id_col)
    model = fit(rows.join(F.broadcast(known), id_col), names)
    score = model.score()
    return rows.select(id_col, (fold(id_col, folds) == held).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
