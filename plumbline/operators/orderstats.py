"""Exact percentiles by refining histograms: no task holds a key's values or its distinct values.

A round counts, for every key and wanted place, the values of the range that still holds it in equal bins, with the
least and greatest value of each bin; the bin that holds the place is the next range, until it is one value. Bins of the
least and greatest value differ, so every round narrows the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, stored


def _same(keys: list[str], a: str, b: str):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def exact_percentile(df: DataFrame, x: str, keys: list[str], q: float, bins: int = 1024) -> DataFrame:
    """(keys, p): the linearly interpolated ``q`` percentile of the keys' values that are neither null nor NaN.

    Keys without such a value have no row. Infinite values count; between two different infinities there is no value (NaN).
    """
    spark = df.sparkSession
    value = F.col(x).cast("double")
    # values of either infinity take places at the ends and need no bin
    rows = df.select(*keys, value.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    inf = F.lit(float("inf"))
    if not keys:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    finite = F.when(F.abs("x") < inf, F.col("x"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == -inf).alias("low"), F.count(finite).alias("mid"), F.min(finite).alias("a"), F.max(finite).alias("b"))
    at = (F.col("n") - 1) * F.lit(float(q))
    both = stats.withColumn("place", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).withColumn("at", at)
    inside = F.col("place").between(F.col("low"), F.col("low") + F.col("mid") - 1)
    edge = F.when(F.col("place") < F.col("low"), -inf).otherwise(inf)
    state = both.select(*keys, "place", "at", (F.col("place") - F.col("low")).alias("want"), F.when(inside, F.col("a")).otherwise(edge).alias("a"), F.when(inside, F.col("b")).otherwise(edge).alias("b"))
    state, path = stored(state, "places")
    while state.where("a < b").limit(1).count():
        open_ = state.where("a < b")
        near = rows.alias("r").join(open_.alias("s"), _same(keys, "r", "s") & F.expr("r.x BETWEEN s.a AND s.b"))
        share = (F.col("x") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2)
        binned = near.select(*[F.col(f"s.{k}").alias(k) for k in keys], "place", "at", "want", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"), "x")
        counts = binned.groupBy(*keys, "place", "at", "want", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "place", "at", "want").orderBy("bin"))  # at most ``bins`` rows
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("c") <= F.col("want")))
        next_ = found.select(*keys, "place", "at", (F.col("want") - F.col("upto") + F.col("c")).alias("want"), "a", "b")
        fresh, at_ = stored(state.where("a >= b").unionByName(next_), "places")
        forget(spark, path)
        state, path = fresh, at_
    low, high = F.min_by("a", "place"), F.max_by("a", "place")
    frac = F.max("at") - F.min("place")
    out = state.groupBy(*keys).agg(F.when(low == high, low).otherwise(low + (high - low) * frac).alias("p"))
    return out.drop("_all")
