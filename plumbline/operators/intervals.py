"""Intervals of ranking metrics under resampling of clusters, all resamples in one pass.

A cluster's multiplicity in a resample is a Poisson(1) draw from a hash. Instead of a row for each resample, sums of
multiplicities are vectors, an entry for each resample; the first entry is the data as they are, every row once. Scores
lie in ranges; the vectors of whole ranges are summed, then added up before each range, and inside a range distinct
scores are walked in order. A task holds one range of rows, and some vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, stored
from .boosting import U, mix
from .evalstats import POISSON
from .ranks import in_ranges

METRICS = ("auroc", "average_precision")
_STEPS = np.array(POISSON)


def multiplicities(clusters: np.ndarray, resamples: int) -> np.ndarray:
    """Clusters x (1 + resamples): how often a cluster, given by a hash, stands in each resample; the first column is 1."""
    draw = mix(mix(clusters.view(U))[:, None] ^ mix(np.arange(resamples, dtype=U))[None, :])
    out = np.ones((len(clusters), resamples + 1), np.uint8)
    out[:, 1:] = np.searchsorted(_STEPS, (draw >> U(11)).astype(float) / float(1 << 53), side="right")
    return out


def _weights(got: pa.Table, resamples: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of positives, sum of negatives) of some rows, by resample."""
    y, n = got.column("y").to_numpy(), got.column("n").to_numpy()
    out = np.zeros((2, resamples + 1))
    for at in range(0, len(y), 2048):
        m = multiplicities(got.column("c").to_numpy()[at : at + 2048], resamples)
        for k in (0, 1):
            out[k] += np.where(y[at : at + 2048] == 1 - k, n[at : at + 2048], 0) @ m
    return out[0], out[1]


def _pack(**columns) -> pa.Table:
    return pa.table({k: [v.astype("<f8").tobytes()] if isinstance(v, np.ndarray) else [v] for k, v in columns.items()})


_vector = lambda raw: np.frombuffer(raw, "<f8")


def paired_metric_interval(df: DataFrame, keys: list[str], cluster: str, reference: str, comparator: str, metric: str = "auroc", resamples: int = 2000, level: float = 0.95, ranges: int = 256) -> DataFrame:
    """(keys, reference, comparator, delta, low, high, favours) of (keys, y, cluster and two scores).

    ``delta`` is the reference's metric minus the comparator's, and its interval is over resamples of clusters in which
    both are defined. y is 0 or 1; rows with a null in y or either score take no part. Where the metric is undefined, so
    are delta and interval (NaN), and neither is favoured.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = df.where(F.col("y").isNotNull() & F.col(reference).isNotNull() & F.col(comparator).isNotNull())
    named = rows.select(*keys, F.to_json(F.struct(*keys) if keys else F.struct(F.lit(0))).alias("_key"), F.col("y").cast("int").alias("_y"), F.xxhash64(F.col(cluster)).alias("_c"), F.col(reference).cast("double").alias("_a"), F.col(comparator).cast("double").alias("_b"))
    arms = named.select(F.col("_key").alias("k"), F.col("_y").alias("y"), F.col("_c").alias("c"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("arm"), F.col("_a").alias("score")), F.struct(F.lit(1).cast("long").alias("arm"), F.col("_b").alias("score")))).alias("x")).select("k", "x.arm", "x.score", "y", "c")
    counts = arms.groupBy("k", "arm", "score", "y", "c").agg(F.count(F.lit(1)).alias("n"))
    dealt = in_ranges(counts, "score", ["k", "arm"], ranges).withColumn("r", F.col("_range").cast("long")).drop("_range")
    dealt, path = stored(dealt, "score-ranges")  # read three times: its ranges must not be found anew

    def total(key: tuple, got: pa.Table) -> pa.Table:
        pos, neg = _weights(got, resamples)
        return _pack(k=key[0].as_py(), arm=key[1].as_py(), r=key[2].as_py(), pos=pos, neg=neg)

    def before(key: tuple, got: pa.Table) -> pa.Table:
        """For each range what lies below it (auroc) or above it (average precision)."""
        order = np.argsort(got.column("r").to_numpy())[:: 1 if metric == "auroc" else -1]
        out, pos, neg = [], np.zeros(resamples + 1), np.zeros(resamples + 1)
        for i in order:
            out.append((got.column("r")[i].as_py(), pos.tobytes(), neg.tobytes()))
            pos, neg = pos + _vector(got.column("pos")[i].as_py()), neg + _vector(got.column("neg")[i].as_py())
        return pa.table({"k": [key[0].as_py()] * len(out), "arm": pa.array([key[1].as_py()] * len(out), pa.int64()), "r": [o[0] for o in out], "pos": [o[1] for o in out], "neg": [o[2] for o in out]})

    def walked(key: tuple, own: pa.Table, start: pa.Table) -> pa.Table:
        own = own.sort_by([("score", "ascending" if metric == "auroc" else "descending")]).combine_chunks()
        pos, neg = (_vector(start.column(c)[0].as_py()).copy() for c in ("pos", "neg"))
        first, score, area = (pos.copy(), neg.copy()), own.column("score").to_numpy(), np.zeros(resamples + 1)
        edges = np.flatnonzero(np.concatenate([[True], ~((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))), [True]]))
        for a, b in zip(edges, edges[1:], strict=False):
            p, q = _weights(own.slice(a, b - a), resamples)
            if metric == "auroc":
                area += p * (neg + q / 2)
            else:
                area += np.divide(p * (pos + p), pos + p + neg + q, out=np.zeros_like(p), where=pos + p + neg + q > 0)
            pos, neg = pos + p, neg + q
        return _pack(k=key[0].as_py(), arm=key[1].as_py(), area=area, pos=pos - first[0], neg=neg - first[1])

    def told(key: tuple, got: pa.Table) -> pa.Table:
        value = []
        for arm in (0, 1):
            own = [i for i, a in enumerate(got.column("arm").to_pylist()) if a == arm]
            area, pos, neg = (np.sum([_vector(got.column(c)[i].as_py()) for i in own], axis=0) for c in ("area", "pos", "neg"))
            with np.errstate(divide="ignore", invalid="ignore"):
                value.append(np.where((pos > 0) & (neg > 0), area / (pos * neg if metric == "auroc" else pos), np.nan))
        delta = value[0] - value[1]
        drawn = delta[1:][~np.isnan(delta[1:])]
        low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2]) if len(drawn) else (np.nan, np.nan)
        return pa.table({"k": [key[0].as_py()], "reference": [value[0][0]], "comparator": [value[1][0]], "delta": [delta[0]], "low": [float(low)], "high": [float(high)]})

    vectors = "k string, arm long, r long, pos binary, neg binary"
    sums = dealt.groupBy("k", "arm", "r").applyInArrow(total, vectors)
    starts = sums.groupBy("k", "arm").applyInArrow(before, vectors)  # a row for each range
    parts = dealt.groupBy("k", "arm", "r").cogroup(starts.groupBy("k", "arm", "r")).applyInArrow(walked, "k string, arm long, area binary, pos binary, neg binary")
    out = parts.groupBy("k").applyInArrow(told, "k string, reference double, comparator double, delta double, low double, high double")
    out, _ = stored(out, "intervals")  # a row for each set of keys
    forget(df.sparkSession, path)
    favours = F.when((F.col("low") > 0) & ~F.isnan("low"), "reference").when((F.col("high") < 0) & ~F.isnan("high"), "comparator").otherwise("neither")
    return named.select(*keys, "_key").distinct().join(out.withColumnRenamed("k", "_key"), "_key").drop("_key").withColumn("favours", favours)
