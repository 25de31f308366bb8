"""Metrics of (keys, y, score) tables, one row for each set of keys. Undefined metrics are NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import rank_table, with_ranks

NAN = float("nan")


def _or_nan(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(NAN))


def accuracy(df: DataFrame, keys: list[str], at: float = 0.5) -> DataFrame:
    """Share of rows where (score > at) equals y = 1; the threshold itself counts as negative."""
    return df.groupBy(*keys).agg(F.avg(((F.col("score") > at).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve from average ranks; NaN with one class."""
    pos = F.sum((F.col("y") == 1).cast("double")).alias("_pos")
    neg = F.sum((F.col("y") == 0).cast("double")).alias("_neg")
    ranked = rank_table(df.select(*keys, "y", "score"), "score", keys, (pos, neg))
    got = ranked.groupBy(*keys).agg(F.sum(F.col("_pos") * F.col("_rank")).alias("_s"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    area = (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))
    return got.select(*keys, _or_nan((F.col("_p") > 0) & (F.col("_q") > 0), area).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct thresholds of precision times the step in recall; NaN with one class."""
    tp = F.sum((F.col("y") == 1).cast("double")).alias("tp")
    steps = rank_table(df.select(*keys, "y", "score"), "score", keys, (tp,), running=("tp",))
    # rows and positives from this score up
    above = F.col("_all") - F.col("_rank") + (F.col("_n") + 1) / 2
    run = steps.select(*keys, F.col("tp").alias("_tp"), (F.col("_all_tp") - F.col("_upto_tp") + F.col("tp")).alias("_ctp"), above.alias("_cn"), F.col("_all_tp").alias("_p"), "_all")
    out = run.groupBy(*keys).agg(F.sum(F.try_divide(F.col("_tp"), F.col("_p")) * F.col("_ctp") / F.col("_cn")).alias("_ap"), F.first("_p").alias("_p"), F.first("_all").alias("_all"))
    return out.select(*keys, _or_nan((F.col("_p") > 0) & (F.col("_p") < F.col("_all")), F.col("_ap")).alias("average_precision"))


def mae_rmse(df: DataFrame, keys: list[str]) -> DataFrame:
    error = F.col("score") - F.col("y")
    return df.groupBy(*keys).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def spearman(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson correlation of average ranks; NaN with fewer than two rows, non-finite values or a constant side."""
    ranked = with_ranks(df.select(*keys, "y", "score"), {"y": "_a", "score": "_b"}, keys)
    bad = F.max((F.isnan("y") | F.isnan("score") | F.col("y").isNull() | F.col("score").isNull() | (F.abs("y") == float("inf")) | (F.abs("score") == float("inf"))).cast("int"))
    got = ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")).alias("_c"), F.count(F.lit(1)).alias("_n"), bad.alias("_bad"), F.min("_a").alias("_a0"), F.max("_a").alias("_a1"), F.min("_b").alias("_b0"), F.max("_b").alias("_b1"))
    ok = (F.col("_n") > 1) & (F.col("_bad") == 0) & (F.col("_a0") < F.col("_a1")) & (F.col("_b0") < F.col("_b1"))
    return got.select(*keys, _or_nan(ok, F.col("_c")).alias("spearman"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): 1 / count, scaled to sum to the number of classes; fewer than two classes are an error."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # a row for each class
    raw = 1 / F.greatest(F.col("n"), F.lit(1)).cast("double")
    weighed = counts.withColumn("_w", raw).withColumn("_k", F.count(F.lit(1)).over(every)).withColumn("_t", F.sum("_w").over(every))
    return weighed.select("label", "n", F.when(F.col("_k") > 1, F.col("_w") * F.col("_k") / F.col("_t")).otherwise(F.raise_error(F.lit("one class only")).cast("double")).alias("weight"))


def task_context(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of positives and imbalance 2 * |1/2 - share| of each task."""
    share = F.avg((F.col(label) == 1).cast("double"))
    return df.groupBy(*keys).agg(share.alias("positive"), (2 * F.abs(F.lit(0.5) - share)).alias("imbalance"))


def context_vector(metric: Column, imbalance: Column) -> dict[str, Column]:
    """The three numbers of a task's context by its primary metric; the imbalance is that of classification only."""
    classes = F.upper(metric).isin("AUROC", "AUPRC")
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {"classification": number(classes), "precision_metric": number(F.upper(metric) == "AUPRC"), "imbalance": F.when(classes, imbalance).otherwise(0.0)}


def positive_weight(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """max(1, negatives / max(positives, 1))."""
    pos, neg = F.sum((F.col(label) == 1).cast("double")), F.sum((F.col(label) == 0).cast("double"))
    return df.groupBy(*keys).agg(F.greatest(F.lit(1.0), neg / F.greatest(pos, F.lit(1.0))).alias("scale_pos_weight"))


def is_classification(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Whether all labels are finite and round to 0 or 1; no labels count as classification."""
    ok = F.coalesce(~F.isnan(label) & (F.abs(F.col(label) - F.rint(label)) < 1e-8) & F.rint(label).isin(0.0, 1.0), F.lit(False))
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("classification"))
