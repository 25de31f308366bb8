"""Kernel machines of radial basis functions: landmarks, then Newton steps on a smoothed hinge loss.

Landmarks are a bounded sample of the training rows, those of least hash. A row's kernel values with the landmarks, times
the inverse root of the landmarks' own kernel matrix, are features whose inner products approximate the kernel, and are
the kernel itself where all rows are landmarks. On them the machine minimises |w|^2 / 2 + C * weighted hinge losses, the
intercept free; the hinge is rounded over a width that shrinks to ``sharp``, so decision values are within that order of
the exact machine's. Several heads are fitted at once: each pass over the rows serves all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from .orderstats import exact_percentile
from .sums import Pairs, added, gram, matrix, moments, wide


@dataclass(frozen=True)
class Kernel:
    """A kernel head: the slice of ``values`` it sees, C, gamma times width, the number of principal components, if any, and whether classes are balanced."""

    start: int
    width: int
    c: float = 1.0
    factor: float = 1.0
    pca: int | None = None
    balanced: bool = True


def column_medians(df: DataFrame, values: str = "values") -> list[float]:
    """The exact median of each component's finite values, 0 where there are none; a number for each component."""
    long = df.select(F.posexplode(values).alias("i", "x")).where(is_finite(F.col("x")))
    found = {r["i"]: r["p"] for r in exact_percentile(long, "x", ["i"], 0.5).collect()}
    n = df.agg(F.max(F.size(values)).alias("n")).collect()[0]["n"] or 0
    return [found.get(i, 0.0) for i in range(n)]


@dataclass(frozen=True)
class Head:
    """What a head does to rows: standardise, turn, compare with landmarks, weigh."""

    start: int
    mean: np.ndarray
    turn: np.ndarray
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.start : self.start + len(self.mean)] - self.mean) @ self.turn

    def features(self, x: np.ndarray) -> np.ndarray:
        return kernel(self.prepared(x), self.landmarks, self.gamma) @ self.root


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (-2 * a) @ b.T
    d += (a * a).sum(axis=1)[:, None]
    d += (b * b).sum(axis=1)[None, :]
    np.maximum(d, 0, out=d)
    d *= -gamma
    return np.exp(d, out=d)


def hinge(z: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value and two derivatives of the hinge loss, rounded within ``h`` of 1."""
    mid = np.abs(1 - z) < h
    value = np.where(z >= 1 + h, 0.0, np.where(mid, (1 + h - z) ** 2 / (4 * h), 1 - z))
    return value, np.where(z >= 1 + h, 0.0, np.where(mid, -(1 + h - z) / (2 * h), -1.0)), np.where(mid, 1 / (2 * h), 0.0)


def prepare_heads(train: DataFrame, heads: list[Kernel], landmarks: int) -> list[Head]:
    """Means, turns and landmarks of all heads from three passes over complete rows."""
    n, mean, deviation = moments(train)
    scale = np.where(deviation > 0, deviation, 1.0)
    centred = gram(train, mean)[0] / np.outer(scale, scale) if any(h.pca for h in heads) else None
    few = train.orderBy(F.xxhash64("row_id"), "row_id").limit(landmarks).select("values").collect()
    x = np.array([r["values"] for r in few], float).reshape(len(few), -1)
    out = []
    for h in heads:
        own = slice(h.start, h.start + h.width)
        turn = np.diag(1 / scale[own])
        if h.pca:
            turn = turn @ np.linalg.eigh(centred[own, own])[1][:, ::-1][:, : h.pca]
        gamma = h.factor / turn.shape[1]
        z = (x[:, own] - mean[own]) @ turn
        value, vector = np.linalg.eigh(kernel(z, z, gamma))
        kept = value > 1e-10 * max(value.max(initial=0), 1e-300)
        out.append(Head(h.start, mean[own], turn, gamma, z, vector[:, kept] / np.sqrt(value[kept])))
    return out


def pass_sums(m: Head, w: np.ndarray, h: float, weight: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(second derivatives with the first ones as last column, loss) of rows at weights ``w``.

    Only rows within ``h`` of the hinge have second derivatives, so only theirs are turned by the root; for the others two
    products with a vector do.
    """
    k = kernel(m.prepared(x), m.landmarks, m.gamma)
    value, first, second = hinge(y * (k @ (m.root @ w[:-1]) + w[-1]), h)
    slope, near = weight * first * y, np.flatnonzero(second)
    f = np.column_stack([k[near] @ m.root, np.ones(len(near))])
    return np.column_stack([(f * (weight * second)[near, None]).T @ f, np.append((slope @ k) @ m.root, slope.sum())]), float((weight * value).sum())


def fit_machines(train: DataFrame, heads: list[Kernel], landmarks: int = 512, sharp: float = 0.01, most: int = 60) -> tuple[list[Head], list[np.ndarray]]:
    """(heads, weights with the intercept last) on (row_id, y, values), complete rows; one pass a step for all heads."""
    n, pos = (train.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("p")).collect()[0][k] or 0 for k in (0, 1))
    if not 0 < pos < n:
        raise ValueError("both classes need rows")
    made = prepare_heads(train, heads, landmarks)
    weigh = [(n / (2 * (n - pos)), n / (2 * pos)) if h.balanced else (1.0, 1.0) for h in heads]
    sizes = [m.root.shape[1] + 1 for m in made]
    widths = [w for w in (1.0, 0.3, 0.1, 0.03) if w > sharp] + [sharp]
    theta = [np.zeros(s) for s in sizes]
    step, best, stage = [np.zeros(s) for s in sizes], [np.inf] * len(heads), [0] * len(heads)
    offset = np.concatenate([[0], np.cumsum([s + 1 for s in sizes])])
    rows = wide(train, "y").persist()
    try:
        for _ in range(most):
            open_ = [k for k in range(len(heads)) if stage[k] < len(widths)]
            if not open_:
                break
            now = {k: (theta[k] + step[k], widths[stage[k]]) for k in open_}

            def run(batches: Iterator[pa.RecordBatch], now=now) -> Pairs:
                sums = {k: [0.0, 0.0] for k in now}
                for batch in batches:
                    for at in range(0, batch.num_rows, 4096):
                        part = batch.slice(at, 4096)
                        y, x = np.where(part.column(0).to_numpy() > 0, 1.0, -1.0), matrix(part.column(1))
                        for k, (w, h) in now.items():
                            both, value = pass_sums(made[k], w, h, heads[k].c * np.where(y > 0, weigh[k][1], weigh[k][0]), y, x)
                            sums[k] = [sums[k][0] + both, sums[k][1] + value]
                for k, (both, value) in sums.items():
                    if np.ndim(both):
                        yield from zip(range(int(offset[k]), int(offset[k + 1]) - 1), both, strict=True)
                        yield int(offset[k + 1]) - 1, np.array([value])

            got = added(rows, run)
            for k, (w, _) in now.items():
                value = float(got[int(offset[k + 1]) - 1][0]) + w[:-1] @ w[:-1] / 2
                if value > best[k] + 1e-12 * abs(best[k]):
                    step[k] = step[k] / 2
                    if np.abs(step[k]).max() < 1e-9:
                        theta[k], step[k], best[k], stage[k] = w, np.zeros(sizes[k]), np.inf, stage[k] + 1
                    continue
                both = np.stack([got[i] for i in range(int(offset[k]), int(offset[k + 1]) - 1)])
                penalty = np.append(np.ones(sizes[k] - 1), 1e-8)
                gradient = both[:, -1] + w * np.append(np.ones(sizes[k] - 1), 0.0)
                theta[k], best[k] = w, value
                step[k] = -np.linalg.solve(both[:, :-1] + np.diag(penalty), gradient)
                if np.abs(gradient).max() < 1e-6 * max(1.0, n * heads[k].c) or np.abs(step[k]).max() < 1e-7:
                    step[k], best[k], stage[k] = np.zeros(sizes[k]), np.inf, stage[k] + 1
    finally:
        rows.unpersist()
    return made, theta


def decision_values(query: DataFrame, made: list[Head], weights: list[np.ndarray]) -> DataFrame:
    """(row_id, head, score) of complete rows: each head's decision value."""
    sent = query.sparkSession.sparkContext.broadcast((made, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1))
                for k, (m, w) in enumerate(zip(*sent.value, strict=True)):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(x), k, np.int32)), pa.array(m.features(x) @ w[:-1] + w[-1])], ["row_id", "head", "score"])

    return query.select(F.col("row_id").cast("long"), F.transform("values", lambda v: v.cast("double")).alias("values")).mapInArrow(run, "row_id long, head int, score double")
