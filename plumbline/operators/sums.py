"""Sums of numbered arrays over all tasks, and per-column moments from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = "i long, sums binary"
Pairs = Iterator[tuple[int, np.ndarray]]


def _met(pairs: Pairs) -> pa.RecordBatch:
    found: dict[int, np.ndarray] = {}
    for i, a in pairs:
        found[i] = found[i] + a if i in found else np.array(a, np.float64)
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([a.astype("<f8").tobytes() for a in found.values()], pa.binary())], ["i", "sums"])


def added(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Pairs]) -> dict[int, np.ndarray]:
    """The sum of the arrays of each number that ``run`` yields over the tasks; a task sends one array for each number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _met(run(batches))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _met((i, np.frombuffer(raw, "<f8")) for batch in batches for i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    rows = df.mapInArrow(each, _ROW).repartition("i").mapInArrow(meet, _ROW).collect()
    return {r["i"]: np.frombuffer(bytes(r["sums"]), "<f8") for r in rows}


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x components of an array column of equally long rows without nulls."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def wide(df: DataFrame, *cols: str, values: str = "values") -> DataFrame:
    """``cols`` as doubles and the array of values, for tasks."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.transform(values, lambda v: v.cast("double")).alias("values"))


def moments(df: DataFrame, values: str = "values") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population deviation) of each component; the deviation takes a pass of its own around the mean."""
    rows = wide(df, values=values)

    def totals(batches: Iterator[pa.RecordBatch]) -> Pairs:
        for batch in batches:
            if batch.num_rows:
                yield 0, np.append(matrix(batch.column(0)).sum(axis=0), batch.num_rows)

    first = added(rows, totals).get(0, np.zeros(1))
    n = int(first[-1])
    mean = first[:-1] / max(n, 1)

    def squares(batches: Iterator[pa.RecordBatch]) -> Pairs:
        for batch in batches:
            if batch.num_rows:
                yield 0, ((matrix(batch.column(0)) - mean) ** 2).sum(axis=0)

    return n, mean, np.sqrt(added(rows, squares).get(0, np.zeros(len(mean))) / max(n, 1))


def gram(df: DataFrame, centre: np.ndarray, values: str = "values", y: str | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(sum of (x - centre)(x - centre)^T, sum of (x - centre) y, sum of y, rows): a row of the matrix is summed at a time."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Pairs:
        for batch in batches:
            if n := batch.num_rows:
                x, t = matrix(batch.column(1)) - centre, batch.column(0).to_numpy(zero_copy_only=False)
                g = np.column_stack([x.T @ x, x.T @ t])
                yield from enumerate(g)
                yield d, np.array([t.sum(), n])

    rows = wide(df.withColumn("_y", F.col(y) if y else F.lit(0.0)), "_y", values=values)
    got = added(rows, run)
    if not got:
        return np.zeros((d, d)), np.zeros(d), 0.0, 0
    both = np.stack([got[i] for i in range(d)]) if d else np.zeros((0, 1))
    return both[:, :-1], both[:, -1], float(got[d][0]), int(got[d][1])
