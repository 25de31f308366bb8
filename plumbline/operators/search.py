"""Pruning of a search: successive halving over a history of metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def halved(history: DataFrame, rungs: list[int], eta: int = 2, lower_is_better: bool = False) -> DataFrame:
    """(study, arm, best, stopped): ``stopped`` is the rung after which an arm was given up, null for those that were not.

    ``history``: study, arm, epoch, metric. At each rung (an epoch) the arms that are left are ordered by their best metric
    so far, ties to the smaller arm, arms without one last, and one in ``eta`` goes on, rounded up. A study's arms meet
    in one window, never its epochs.
    """
    sign = -1 if lower_is_better else 1
    score = F.when(~F.isnan("metric"), sign * F.col("metric"))
    best = [F.max(F.when(F.col("epoch") <= r, score)).alias(f"_b{r}") for r in rungs]
    arms = history.groupBy("study", "arm").agg(F.max(score).alias("_best"), *best).withColumn("stopped", F.lit(None).cast("int"))
    for r in rungs:
        left = F.col("stopped").isNull()
        line = Window.partitionBy("study", left).orderBy(F.col(f"_b{r}").desc_nulls_last(), "arm")
        count = F.count(F.lit(1)).over(Window.partitionBy("study", left))
        keep = F.ceil(count / F.lit(eta))
        arms = arms.withColumn("_out", left & (F.row_number().over(line) > keep)).withColumn("stopped", F.when(F.col("_out"), F.lit(r)).otherwise(F.col("stopped")))
    return arms.select("study", "arm", (sign * F.col("_best")).alias("best"), "stopped")


def search(fit: Callable[[list, int, int], DataFrame], arms: list, rungs: list[int], eta: int = 2, lower_is_better: bool = False) -> tuple[DataFrame, list]:
    """(history, arms that were never given up): ``fit`` runs the arms that are left from one rung to the next.

    ``fit(arms, first, last)`` gives (arm, epoch, metric) of epochs first + 1 to last; it fits its arms side by side.
    """
    left, history, before = list(arms), None, 0
    for r in rungs:
        new = fit(left, before, r).select(F.lit(0).alias("study"), "arm", "epoch", "metric")
        history = new if history is None else history.unionByName(new)
        told = halved(history, [x for x in rungs if x <= r], eta, lower_is_better).where("stopped IS NULL").select("arm").collect()  # arms of a search
        left, before = sorted(t["arm"] for t in told), r
    return history.drop("study"), left
