"""Evaluation statistics over (task, arm, seed, score) and (row_id, y, score, cluster) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform_of


def run_mean_sd(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean and population deviation over runs."""
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(F.lit(1)).alias("runs"))


def mean_method_rank(df: DataFrame, task: str, arm: str, score: str, lower_is_better: bool = False) -> DataFrame:
    """(arm, mean_rank, tasks): average rank of each arm within its tasks, rank 1 the best, then the mean over tasks."""
    side = F.col(score) if lower_is_better else -F.col(score)
    w = Window.partitionBy(task).orderBy("_o")
    rank = (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0
    return df.withColumn("_o", side).withColumn("_r", rank).groupBy(arm).agg(F.avg("_r").alias("mean_rank"), F.count(F.lit(1)).alias("tasks"))


def relative_change(value: Column, reference: Column, lower_is_better: Column) -> Column:
    """Percent change over a reference, positive where it is better."""
    change = F.try_divide(100 * (value - reference), reference)
    return F.when(lower_is_better, -change).otherwise(change)


def verdict(difference: Column, eps: float = 1e-9) -> Column:
    return F.when(F.abs(difference) <= eps, "tie").when(difference > 0, "better").otherwise("worse")


def overlap_audit(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys of the source, and how many of either also occur in the target."""
    counts = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))  # a common key is one row from here on
    marked = counts.join(target.select(F.col(key)).distinct().withColumn("_hit", F.lit(1)), key, "left")
    hit = F.col("_hit").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return marked.agg(total("_n").alias("rows"), F.count(key).alias("keys"), total(F.when(hit, F.col("_n"))).alias("rows_shared"), F.count(F.when(hit, F.col(key))).alias("keys_shared"))


#: Distribution function of Poisson(1) at 0, 1, ... 6 (fixed values).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def _resampled(sums: DataFrame, keys: list[str], resamples: int, level: float, means: dict[str, Column]) -> DataFrame:
    """(keys, low, high): percentile interval of the statistic ``_m`` over resamples of clusters; sums of ``means`` by weight ``_t``."""
    draws = sums.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = uniform_of(F.concat_ws("|", F.col("_b").cast("string"), F.col("_c").cast("string")))
    times = sum(((u >= s).cast("int") for s in POISSON[1:]), (u >= POISSON[0]).cast("int"))
    each = draws.withColumn("_t", times).groupBy(*keys, "_b").agg(*[F.sum(c * F.col("_t")).alias(k) for k, c in means.items()])
    stat = each.withColumn("_m", F.try_divide("_sum", "_count"))
    return stat.groupBy(*keys).agg(F.percentile("_m", F.lit((1 - level) / 2)).alias("low"), F.percentile("_m", F.lit((1 + level) / 2)).alias("high"))


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, value: str, resamples: int = 2000, level: float = 0.95) -> DataFrame:
    """(keys, mean, low, high): percentile interval of the mean under resampling of whole clusters.

    Each cluster is first summed up to one row, so copies for the resamples number clusters x resamples, never rows. A
    cluster's multiplicity in a resample is a Poisson(1) draw from a hash of (resample, cluster): the same everywhere.
    """
    sums = df.groupBy(*keys, F.col(cluster).alias("_c")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    ends = _resampled(sums, keys, resamples, level, {"_sum": F.col("_s"), "_count": F.col("_n")})
    return sums.groupBy(*keys).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("mean")).join(ends, keys)


def paired_bootstrap(df: DataFrame, keys: list[str], cluster: str, reference: str, comparator: str, lower_is_better: bool = False, resamples: int = 2000, level: float = 0.95) -> DataFrame:
    """(keys, delta, low, high, favours): difference of two arms' means on the same rows, and its interval over clusters.

    Both arms get the same resampled clusters. ``delta`` is positive where the reference is better; ``favours`` names the
    arm that the whole interval is on the side of, else "neither". Rows without either value take no part.
    """
    side = F.col(comparator) - F.col(reference) if lower_is_better else F.col(reference) - F.col(comparator)
    paired = df.select(*keys, F.col(cluster).alias("_c"), side.alias("_d")).where(F.col("_d").isNotNull())
    sums = paired.groupBy(*keys, "_c").agg(F.sum("_d").alias("_s"), F.count(F.lit(1)).alias("_n"))
    ends = _resampled(sums, keys, resamples, level, {"_sum": F.col("_s"), "_count": F.col("_n")})
    out = sums.groupBy(*keys).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("delta")).join(ends, keys)
    return out.withColumn("favours", F.when(F.col("low") > 0, "reference").when(F.col("high") < 0, "comparator").otherwise("neither"))


def best_so_far(df: DataFrame, keys: list[str], order: str, score: str, lower_is_better: bool = False) -> DataFrame:
    """Adds best (so far, this row included), improved (strictly better than all before) and stale (rows since then)."""
    line = Window.partitionBy(*keys).orderBy(order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ext, s = (F.min, -1) if lower_is_better else (F.max, 1)
    prev = ext(score).over(before)
    better = prev.isNull() | (s * F.col(score) > s * prev)
    at = F.row_number().over(line)
    df = df.withColumn("best", ext(score).over(upto)).withColumn("improved", better).withColumn("_at", at)
    last = F.max(F.when(F.col("improved"), F.col("_at"))).over(upto)
    return df.withColumn("stale", (F.col("_at") - last).cast("long")).drop("_at")


def stopped(df: DataFrame, keys: list[str], order: str, patience: int) -> DataFrame:
    """Rows up to the first whose ``stale`` reaches the patience, from :func:`best_so_far`."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("stale")).over(upto), F.lit(0))
    return df.withColumn("_over", over).where(F.col("_over") < patience).drop("_over")
