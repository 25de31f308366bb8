"""Connected components of an edge table; nothing is collected on the driver.

Up to ``SMALL`` distinct edges, counted first, fit one task, which joins them in memory. Beyond that, large-star and
small-star steps alternate until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import drop, written


SMALL = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) by hooking roots to lesser ones and halving paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if np.array_equal(p, q):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One step on directed pairs (u, v): link each node's neighbours to its least neighbour or itself."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where("v <= u") if small else both
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = near.join(least, "u")
    if small:
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for each node of an edge (a, b), root the least node it is connected with.

    Nulls and self-loops are left out; an edgeless table gives no rows. Every round is written to the shared folder, and
    the loop ends when a round leaves all pairs as they were. The pairs never grow beyond nodes plus edges.
    """
    spark = edges.sparkSession
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, at = written(pairs, "components")
    if pairs.count() <= SMALL:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            none = np.zeros(0, np.int64)
            nodes, roots = joined(*(np.concatenate([none, *(g[k] for g in got)]) for k in (0, 1)))
            for k in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(roots[k : k + 100_000])], ["node", "root"])

        return pairs.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")
    state = None
    for _ in range(rounds):
        large, at_large = written(_star(pairs, small=False), "components")
        new, at_new = written(_star(large, small=True), "components")
        drop(spark, at, at_large)
        pairs, at = new, at_new
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        now = (row[0], row[1])
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
