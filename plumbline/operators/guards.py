"""Checks of keyed tables. Reports are tables; ``ensure_*`` make a query fail when its result is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite


def invalid_rows(df: DataFrame, ok: Column, key: str = "row_id") -> DataFrame:
    """Keys of the rows that fail a predicate; a null predicate fails."""
    return df.where(~F.coalesce(ok, F.lit(False))).select(key)


def ensure_finite(df: DataFrame, col: str) -> DataFrame:
    checked = F.when(is_finite(F.col(col)), F.col(col)).otherwise(F.raise_error(F.lit(f"{col}: not finite")).cast(df.schema[col].dataType))
    return df.withColumn(col, checked)


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right, and keys that either side repeats."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, key, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), n(F.col("_b").isNull()).alias("left_only"), n(F.col("_a").isNull()).alias("right_only"), n((F.coalesce("_a", F.lit(0)) > 1) | (F.coalesce("_b", F.lit(0)) > 1)).alias("repeated"))


def widths(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(F.size(col)).alias("least"), F.max(F.size(col)).alias("most"))


def check_run(run: int, runs: int = 5) -> int:
    if not 1 <= run <= runs:
        raise ValueError(f"run {run} is not in 1..{runs}")
    return run


def check_seeds(seeds: list[int], expected: list[int]) -> None:
    if list(seeds) != list(expected):
        raise ValueError(f"seed_ids {seeds} are not {expected}")


def unknown_keys(config: Column, known: list[str]) -> Column:
    """Keys of a map column that are not known."""
    return F.array_except(F.map_keys(config), F.array(*map(F.lit, known)))
