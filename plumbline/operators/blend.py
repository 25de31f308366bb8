"""Weighted combinations of component scores, as long keyed tables (keys, component, row_id, score)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from .ranks import normalized_rank, transformed, zscore64


def weight_table(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(component, weight), a row for each component of a rule; weights must be finite."""
    if not weights or not all(math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite and not empty")
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "component string, weight double")


def blend(df: DataFrame, weights: dict[str, float], mode: str = "raw", keys: tuple[str, ...] = (), squash: bool = False) -> DataFrame:
    """Sum of weight * f(score) for each (keys, row_id) as ``score``.

    Only listed components count; a row that lacks one is an error when the result is read. Each (keys, component) is
    ranked or scaled by itself.
    """
    keys = list(keys)
    rule = F.broadcast(weight_table(df, weights))  # one row for each component of the rule
    each = transformed(df.join(rule, "component"), "score", [*keys, "component"], mode)
    out = each.groupBy(*keys, "row_id").agg(F.sum(F.col("weight") * F.col("f")).alias("score"), F.count(F.lit(1)).alias("_n"))
    score = sigmoid(F.col("score")) if squash else F.col("score")
    whole = F.when(F.col("_n") == len(weights), score).otherwise(F.raise_error(F.lit("components don't cover the same rows")).cast("double"))
    return out.select(*keys, "row_id", whole.alias("score"))


def seed_mean(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean of the raw scores of all seeds for each (keys, row_id)."""
    return df.groupBy(*keys, "row_id").agg(F.avg("score").alias("score"))


def seedwise_zscore_blend(df: DataFrame, weights: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """For each seed a blend of z-scores, then the mean over seeds. Rows are (keys, seed, component, row_id, score)."""
    rule = F.broadcast(weight_table(df, weights))
    each = zscore64(df.join(rule, "component"), "score", [*keys, "seed", "component"])
    per_seed = each.groupBy(*keys, "seed", "row_id").agg(F.sum(F.col("weight") * F.col("z")).alias("score"))
    return seed_mean(per_seed, keys)


def nested_rank_blend(df: DataFrame, stages: list[tuple[str, dict[str, float]]], keys: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Stages in order, each a weighted sum of normalised ranks of columns or earlier stages; the last one is ``score``.

    ``df`` is wide: keys, row_id and a column for each input. Every stage ranks again what the stage before it made, in
    one sort of each set of keys. With ``digits`` the sums are rounded, so that equal ones tie in any order of addition.
    """
    for name, weights in stages:
        total = None
        for k, w in weights.items():
            df = df.withColumn(f"_r_{k}", normalized_rank(k, list(keys)))
            term = F.lit(float(w)) * F.col(f"_r_{k}")
            total = term if total is None else total + term
        total = total if digits is None else F.round(total, digits)
        df = df.withColumn(name, total).drop(*[f"_r_{k}" for k in weights])
    return df.select(*keys, "row_id", F.col(stages[-1][0]).alias("score"))


def wide_to_long(df: DataFrame, components: dict[str, str], keep: list[str]) -> DataFrame:
    """(keep, component, score) from one column expression for each component."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), F.expr(e).cast("double").alias("score")) for c, e in components.items()])
    return df.select(*keep, F.inline(pairs))
