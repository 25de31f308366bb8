"""Operator 12: exact integer k-means with bounds that geometric drift tightens.

Every vector keeps its cluster and a lower bound of its distance to all other centroids. After a round the centroids
move; where a vector's distance to its own moved centroid is below the loosened bound, no other centroid can be nearest.
The bound is loosened by less than the largest drift: the vectors of a cluster lie in the sphere of its old centroid and
largest distance, and in the plane of that centre and another centroid's old and new place, points that came closer to
the new place by 2A lie inside a hyperbola branch, hence inside the cone around the direction of the move with half-angle
acos(A / c), 2c being the drift. A sphere seen from the middle of the move at angle phi with angular radius
asin(r / R) meets only cones that are at least as wide as the difference, so 2c * cos(phi - asin(r / R)) bounds what the
distance can have lost, and nothing is lost beyond a right angle. All other vectors are compared with all centroids, in
exact integers; ties go to the smaller number.

Each round reads a table of the shared folder and writes the next; sums for the next centroids are rows of the same
table, one for each cluster and task at most, so that a round reads each vector once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import drop, written

DIM = 64
MOST = 1 << 27  # squared distances of components up to this size fit in 62 bits
_STATE = "vec_id long, vec binary, cluster int, lower double, squared long, n long, sums array<long>, inertia decimal(38,0), radius long, scanned long"


def integer_components(table: DataFrame, scale: float = 256.0, id_col: str = "vec_id", col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component as little-endian 32-bit integers.

    Left out are null vectors, those of another length and those with null or non-finite components, and vectors with a
    component beyond +-2^27 after scaling, as their squared distances need not fit in a long. A null id stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            fit = np.flatnonzero(np.array([v is not None and len(v) == dim for v in vecs.to_pylist()], bool)) if batch.num_rows else np.zeros(0, np.int64)
            flat = vecs.take(pa.array(fit)).flatten()
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                good = (np.abs(x) <= MOST).all(axis=1)  # false for what is not finite
            raw = x[good].astype("<i4")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(fit[good])), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "vec"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col)).mapInArrow(run, "vec_id long, vec binary")


def first_centroids(vectors: DataFrame, k: int = 40, seed: int = 2) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of ``seed:vec_id``; null ids come last, equal ids by their vectors. Fewer vectors give fewer centroids."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("vec", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["vec"]), "<i4") for r in rows], np.int64) if rows else np.zeros((0, DIM), np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids, as 64-bit integers: floats where they hold every partial sum, else integers."""
    big = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * big * big * x.shape[1] < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def drift_bounds(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most that the distance of a vector in its sphere to any other centroid can have lost.

    The sphere of cluster i has centre old[i] and ``radius``[i]; see the module's text for the geometry.
    """
    k = len(old)
    out = np.zeros(k)
    move = (new - old).astype(float)
    drift = np.sqrt((move * move).sum(axis=1))
    middle = (new + old) / 2.0
    for i in range(k):
        to = old[i] - middle  # from the middle of each move to the sphere's centre
        away = np.sqrt((to * to).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = np.arccos(np.clip((to * move).sum(axis=1) / (away * drift), -1, 1))
            wide = np.arcsin(np.clip(radius[i] / away, 0, 1))
        angle = np.where(radius[i] * (1 + 1e-9) >= away, 0.0, np.maximum(phi - wide - 1e-7, 0.0))  # inside the sphere: the whole drift
        lost = np.where(drift > 0, drift * np.maximum(np.cos(angle), 0.0), 0.0) * (1 + 1e-9)
        out[i] = np.delete(lost, i).max(initial=0.0)
    return out


@dataclass(frozen=True)
class Clusters:
    """``vectors``: vec_id, cluster, squared. Of each cluster: centroids, sizes, inertia, and how many vectors each pass scanned."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    scanned: list[int]
    total: list[int]


def _pass(table: DataFrame, centroids: np.ndarray, lost: np.ndarray | None) -> DataFrame:
    """One assignment. Without ``lost`` (the first pass) all vectors are scanned."""
    k, dim = centroids.shape
    names = [f.split(" ")[0] for f in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia, radius, scanned = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), [0] * k, np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(m, dim).astype(np.int64)
            if lost is None:
                own, lower, far = np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64)
                doubt = np.arange(m)
            else:
                own = batch.column(2).to_numpy().astype(np.int64)
                diff = x - centroids[own]
                far = (diff * diff).sum(axis=1)
                lower = batch.column(3).to_numpy() - lost[own]
                doubt = np.flatnonzero(~(np.sqrt(far.astype(float)) * (1 + 1e-9) < lower))
            if len(doubt):
                d = squared_distances(x[doubt], centroids)
                best = d.argmin(axis=1)
                own[doubt], far[doubt] = best, d[np.arange(len(doubt)), best]
                d[np.arange(len(doubt)), best] = np.iinfo(np.int64).max
                lower = lower.copy()
                lower[doubt] = np.sqrt(d.min(axis=1).astype(float)) * (1 - 1e-9) if k > 1 else np.inf
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
            c = own[order][starts]
            n[c] += np.diff(np.append(starts, m))
            sums[c] += np.add.reduceat(x[order], starts, axis=0)
            radius[c] = np.maximum(radius[c], np.maximum.reduceat(far[order], starts))
            scanned += np.bincount(own[doubt], minlength=k)
            high, low = np.add.reduceat(far[order] >> 31, starts), np.add.reduceat(far[order] & 0x7FFFFFFF, starts)
            for j, h, w in zip(c.tolist(), high.tolist(), low.tolist(), strict=True):
                inertia[j] += (h << 31) + w
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(lower), pa.array(far), *none], names)
        c = np.flatnonzero(n)
        total = pa.array([inertia[j] for j in c], pa.decimal128(38, 0))
        none = [pa.nulls(len(c), t) for t in (pa.int64(), pa.binary(), pa.float64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array(c, pa.int32()), none[2], none[3], pa.array(n[c]), pa.array(list(sums[c]), pa.list_(pa.int64())), total, pa.array(radius[c]), pa.array(scanned[c])], names)

    return table.where("vec IS NOT NULL").select("vec_id", "vec", "cluster", "lower").mapInArrow(run, _STATE)


def _summed(table: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[list[int]], list[int], np.ndarray, int]:
    """(counts, sums, inertia, radius, scanned) of each cluster from the rows of sums: k and k * dim rows reach the driver."""
    own = table.where("n IS NOT NULL")
    n, sums, inertia, radius, scanned = np.zeros(k, np.int64), [[0] * dim for _ in range(k)], [0] * k, np.zeros(k), 0
    for r in own.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("i"), F.max("radius").alias("r"), F.sum("scanned").alias("s")).collect():
        n[r["cluster"]], inertia[r["cluster"]], radius[r["cluster"]] = r["n"], int(r["i"]), np.sqrt(float(r["r"])) * (1 + 1e-9)
        scanned += r["s"]
    for r in own.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():
        sums[r["cluster"]][r["i"]] = int(r["x"])
    return n, sums, inertia, radius, scanned


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = 5) -> Clusters:
    """``rounds`` of assignment and update, then one more assignment, of vectors from :func:`integer_components`.

    A non-empty centroid becomes the exact floor of its vectors' mean; empty ones stay. Repeated rows and ids count as
    often as they occur. Without vectors there are no clusters.
    """
    spark, (k, dim) = vectors.sparkSession, centroids.shape if len(centroids) else (0, DIM)
    if not k:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, squared long"), centroids, [], [], [])
    table, lost, before, scanned, total = vectors.select("vec_id", "vec", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("lower")), None, None, [], []
    for r in range(rounds + 1):
        table, at = written(_pass(table, centroids, lost), "clusters", "lz4")
        if before:
            drop(spark, before)
        before = at
        n, sums, inertia, radius, seen = _summed(table, k, dim)
        scanned.append(seen)
        total.append(int(n.sum()))
        if r < rounds:
            new = np.array([[s // int(n[j]) for s in sums[j]] if n[j] else centroids[j] for j in range(k)], np.int64)
            lost, centroids = drift_bounds(centroids, new, radius), new
    return Clusters(table.where("vec IS NOT NULL").select("vec_id", "cluster", "squared"), centroids, inertia, scanned, total)


def clustered(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    The digest is of the final centroid's components as decimal integers joined by commas. An inertia beyond a long is null.
    """
    spark = table.sparkSession
    vectors, at = written(integer_components(table), "cluster-vectors", "lz4")
    found = cluster(vectors, first_centroids(vectors, k, seed), rounds)
    drop(spark, at)
    fits = lambda x: x if x < 1 << 63 else None
    told = [(j, fits(found.inertia[j]), fits(sum(found.inertia)), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    own = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return found.vectors.join(F.broadcast(own), "cluster").select("vec_id", "cluster", F.col("squared").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = DIM) -> str:
    """DuckDB SQL for :func:`clustered` over ``embeddings``: all distances of each round."""
    near = lambda name, cents: f"""{name} AS MATERIALIZED (
  SELECT rid, vec_id, e, c, d FROM (SELECT v.rid, v.vec_id, v.e, m.c, list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, {cents} m)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""  # noqa: E731
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds):
        parts += [
            near(f"a{r}", f"c{r}"),
            f"""s{r} AS (SELECT c, i, CAST(s - ((s % n) + n) % n AS BIGINT) // n AS x FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(e) AS x FROM a{r}) GROUP BY c, i))""",
            f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM s{r} GROUP BY c) m ON m.c = o.c)",
        ]
    parts.append(near("z", f"c{rounds}"))
    return f"""WITH {", ".join(parts)}
SELECT z.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM z JOIN c{rounds} m ON m.c = z.c"""
