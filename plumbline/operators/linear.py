"""Linear models on standardised columns: ridge from one Gram matrix, logistic regression by Newton steps.

A pass over the rows is one aggregate of a d x d matrix, summed by its rows; the d x d systems are solved on the driver
(d is the number of columns). Scores are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import Pairs, added, gram, matrix, moments, wide


@dataclass(frozen=True)
class Linear:
    """Weights of the raw columns and the intercept."""

    weights: np.ndarray
    intercept: float
    classification: bool

    def scores(self, df: DataFrame) -> DataFrame:
        """(row_id, score): the prediction, or the probability of class 1."""
        products = F.zip_with(F.transform("values", lambda v: v.cast("double")), F.lit([float(w) for w in self.weights]), lambda a, b: a * b)
        total = F.aggregate(products, F.lit(float(self.intercept)), lambda a, b: a + b)
        return df.select("row_id", (1 / (1 + F.exp(-total)) if self.classification else total).alias("score"))


def fit_ridge(train: DataFrame, alpha: float = 10.0) -> Linear:
    """Least squares with the penalty ``alpha`` on weights of standardised columns, the intercept free. A constant column's weight is 0."""
    _, mean, deviation = moments(train)
    g, xy, y, n = gram(train, mean, y="y")
    scale = np.where(deviation > 0, deviation, 1.0)
    # centred columns sum to 0: the intercept is the mean of y
    w = np.linalg.solve(g / np.outer(scale, scale) + alpha * np.eye(len(mean)), xy / scale) / scale
    return Linear(w, y / max(n, 1) - float(w @ mean), False)


def fit_logistic(train: DataFrame, c: float = 0.5, centre: bool = True, balanced: bool = True, tol: float = 1e-10, most: int = 100) -> Linear:
    """Minimises |w|^2 / 2 + b^2 / 2 + c * weighted log loss on standardised columns, the intercept penalised like a weight.

    Without ``centre`` columns are divided by their deviation only. Balanced classes weigh rows / (2 * rows of the class).
    """
    n, mean, deviation = moments(train)
    pos = train.agg(F.sum((F.col("y") == 1).cast("long")).alias("p")).collect()[0]["p"] or 0
    if not 0 < pos < n:
        raise ValueError("both classes need rows")
    shift, scale = mean if centre else np.zeros(len(mean)), np.where(deviation > 0, deviation, 1.0)
    weigh = (n / (2 * (n - pos)), n / (2 * pos)) if balanced else (1.0, 1.0)
    rows = wide(train, "y").persist()
    theta, best, step, d = np.zeros(len(mean) + 1), np.inf, np.zeros(len(mean) + 1), len(mean) + 1
    try:
        for _ in range(most):
            now = theta + step

            def run(batches: Iterator[pa.RecordBatch], now=now) -> Pairs:
                for batch in batches:
                    if batch.num_rows:
                        y, x = batch.column(0).to_numpy(), (matrix(batch.column(1)) - shift) / scale
                        x = np.column_stack([x, np.ones(len(x))])
                        f = x @ now
                        p, s = 1 / (1 + np.exp(-f)), c * np.where(y > 0, weigh[1], weigh[0])
                        loss = (s * (np.logaddexp(0, f) - y * f)).sum()
                        yield from enumerate(np.column_stack([(x * (s * p * (1 - p))[:, None]).T @ x, x.T @ (s * (p - y))]))
                        yield d, np.array([loss])

            got = added(rows, run)
            value = float(got[d][0]) + now @ now / 2
            if value > best + 1e-12 * abs(best):  # too far: half the step
                step = step / 2
                continue
            both = np.stack([got[i] for i in range(d)])
            gradient = both[:, -1] + now
            theta, best = now, value
            step = -np.linalg.solve(both[:, :-1] + np.eye(d), gradient)
            if np.abs(gradient).max() <= tol * max(1.0, n * c):
                break
    finally:
        rows.unpersist()
    w = theta[:-1] / scale
    return Linear(w, float(theta[-1] - w @ shift), True)
