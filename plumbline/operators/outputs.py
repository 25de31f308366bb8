"""Prediction files: rows in the order of their ids, numbered from 0, with the truth and the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from ..sources.tables import write_new
from .ranks import rank_table


def prediction_rows(df: DataFrame, classification: bool, label: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(sample_idx, y_true, y_prob) or, for numbers, (sample_idx, y_true, y_pred) of (row_id, y, score).

    ``label`` = (mean, deviation) turns standardised predictions back. A repeated row_id, or a prediction that is not
    finite, makes the query fail when it is read.
    """
    at = rank_table(df.select("row_id"), "row_id", []).select("row_id", (F.col("_rank") - 1).cast("long").alias("sample_idx"), "_n")
    score = F.col("score").cast("double") if classification else F.col("score") * F.lit(label[1]) + F.lit(label[0])
    sure = F.when(~is_finite(score), F.raise_error(F.lit("a prediction is not finite")).cast("double")).when(F.col("_n") > 1, F.raise_error(F.lit("a row id repeats")).cast("double")).otherwise(score)
    return df.join(at, "row_id").select("sample_idx", F.col("y").cast("int" if classification else "double").alias("y_true"), sure.alias("y_prob" if classification else "y_pred"))


def write_predictions(df: DataFrame, path: str, classification: bool, label: tuple[float, float] = (0.0, 1.0)) -> None:
    """CSV files with a header where nothing is yet, rows in order within and over files."""
    write_new(prediction_rows(df, classification, label).orderBy("sample_idx"), path, "csv")
