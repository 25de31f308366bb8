"""Ranks and z-scores of a score within keys.

A key may hold any share of the rows. Ranks come from counts of distinct scores in ranges of about equal size, whose
sums are added up before the ranges meet; z-scores from one aggregate for each key. Both are joined back to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit


def average_rank(score: str, keys: list[str]) -> Column:
    """Ranks from 1 in one window; ties share their mean rank. For keys of a bounded number of rows."""
    w = Window.partitionBy(*keys).orderBy(score)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(w) + upto) / F.lit(2.0)


def normalized_rank(score: str, keys: list[str]) -> Column:
    """Average rank divided by the number of rows, in one window."""
    return average_rank(score, keys) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def joined_back(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``other``, a row for each set of keys; null keys meet null keys."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # one row
    for k in keys:
        other = other.withColumnRenamed(k, f"_j_{k}")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return df.join(other, same).drop(*[f"_j_{k}" for k in keys])


def in_ranges(counts: DataFrame, score: str, keys: list[str], ranges: int = 256) -> DataFrame:
    """Adds ``_range``, from 0: about ``ranges`` ranges of the keys' scores with about equal numbers of rows; nulls are in the first."""
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(F.col(score).cast("double"), [k / ranges for k in range(1, ranges)], 10 * ranges).alias("_cuts"))
    # cuts below a score: first among every 16th, then among the 16 that follow
    some = F.transform(F.sequence(F.lit(16), F.lit(ranges - 1), F.lit(16)), lambda i: F.get("_cuts", i - 1))
    cuts = cuts.withColumn("_some", some)
    whole = 16 * F.size(F.filter("_some", lambda x: x < F.col(score)))
    below = whole + F.size(F.filter(F.slice("_cuts", whole + 1, F.lit(16)), lambda x: x < F.col(score)))
    return joined_back(counts, cuts, keys).withColumn("_range", F.when(F.col("_cuts").isNull() | F.col(score).isNull(), 0).otherwise(below)).drop("_cuts", "_some")


def rank_table(df: DataFrame, score: str, keys: list[str], more: tuple[Column, ...] = (), ranges: int = 256, running: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, _n, _rank, _all) and the aggregates ``more`` for each distinct score: its rows, average rank, all rows of the keys.

    For the aggregates named in ``running`` there are also their sum up to this score, _upto_<name>, and in all, _all_<name>.

    Nulls rank first and NaN last, as in a sort. No task sees more of a key than one of about ``ranges`` ranges of its
    distinct scores and a row for each range.
    """
    dealt = in_ranges(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), *more), score, keys, ranges)
    added = {"_n": "", **{c: f"_{c}" for c in running}}
    sums = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s{x}") for c, x in added.items()])
    line, every = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    starts = sums.select(*keys, "_range", *[y for x in added.values() for y in ((F.sum(f"_s{x}").over(line) - F.col(f"_s{x}")).alias(f"_before{x}"), F.sum(f"_s{x}").over(every).alias(f"_all{x}"))])
    within = Window.partitionBy(*keys, "_range").orderBy(score)
    ranked = joined_back(dealt.withColumns({f"_upto{x}": F.sum(c).over(within) for c, x in added.items()}), starts, [*keys, "_range"])
    ranked = ranked.withColumns({f"_upto{x}": F.col(f"_before{x}") + F.col(f"_upto{x}") for x in added.values()})
    rank = F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
    return ranked.withColumn("_rank", rank).drop("_range", "_upto", *[f"_before{x}" for x in added.values()])


def with_ranks(df: DataFrame, columns: dict[str, str], keys: list[str], normalized: bool = False) -> DataFrame:
    """Adds the average ranks (from 1, ties share their mean; divided by the number of rows if ``normalized``) of columns under new names."""
    out = df
    for score, name in columns.items():
        rank = F.col("_rank") / F.col("_all") if normalized else F.col("_rank")
        ranks = rank_table(df, score, keys).select(*keys, score, rank.alias(name))
        out = joined_back(out, ranks, [*keys, score])
    return out


def _spread(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Adds _mean and _sd, the population deviation, in two passes.

    The second pass also gives what the first mean is off by, so the order of additions doesn't show in the result.
    """
    x = F.col(score).cast("double")
    near = joined_back(df.select(*keys, x.alias(score)), df.groupBy(*keys).agg(F.avg(x).alias("_m")), keys)
    off = F.col(score) - F.col("_m")
    sums = near.groupBy(*keys).agg(F.first("_m").alias("_m"), F.avg(off).alias("_d"), F.avg(off * off).alias("_v"))
    mean = F.col("_m") + F.col("_d")
    step = mean - F.col("_m")  # as rounded; the deviation is about the rounded mean
    sd = F.sqrt(F.greatest(F.col("_v") - 2 * step * F.col("_d") + step * step, F.lit(0.0)))
    return joined_back(df, sums.select(*keys, mean.alias("_mean"), sd.alias("_sd")), keys)


def zscore64(df: DataFrame, score: str, keys: list[str], to: str = "z") -> DataFrame:
    """Double z-scores; zeros only where the deviation is exactly 0."""
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col(score) - F.col("_mean")) / F.col("_sd"))
    return _spread(df, score, keys).withColumn(to, z).drop("_mean", "_sd")


def zscore32(df: DataFrame, score: str, keys: list[str], to: str = "z") -> DataFrame:
    """Float z-scores; zeros where the deviation is below 1e-12."""
    z = F.when(F.col("_sd") < 1e-12, F.lit(0.0)).otherwise((F.col(score) - F.col("_mean")) / F.col("_sd")).cast("float")
    return _spread(df, score, keys).withColumn(to, z).drop("_mean", "_sd")


def transformed(df: DataFrame, score: str, keys: list[str], mode: str, to: str = "f") -> DataFrame:
    """A score by mode: raw, rank, rank_n, zscore, zscore_seed or logit."""
    if mode == "raw":
        return df.withColumn(to, F.col(score).cast("double"))
    if mode == "rank":
        return with_ranks(df, {score: to}, keys)
    if mode == "rank_n":
        return with_ranks(df, {score: to}, keys, normalized=True)
    if mode == "logit":
        return df.withColumn(to, logit(F.col(score).cast("double")))
    if mode == "zscore":
        return zscore32(df, score, keys, to)
    if mode == "zscore_seed":
        return zscore64(df, score, keys, to)
    raise ValueError(f"unknown mode {mode}")
