"""Sampling with replacement and learning-rate schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform_of
from .ranks import rank_table


def draw_with_replacement(df: DataFrame, draws: int | None = None, cell_rows: int = 50_000) -> DataFrame:
    """(draw, row_id): ``draws`` (default: as many as rows) draws in proportion to integer weights, in row_id order.

    Row ids are unique. The running sum of weights comes from ranges of row ids. Cells are equal parts of the whole
    weight; a row stands at the start of its span in every cell that it reaches, and in a cell, sorted once, a draw takes
    the row that stands last before it: no draw meets more than one row.
    """
    ends = df.agg(F.sum("weight").alias("t"), F.count(F.lit(1)).alias("n")).collect()[0]
    if not ends["t"]:
        return df.select(F.lit(0).cast("long").alias("draw"), "row_id").limit(0)
    draws, total = draws or ends["n"], int(ends["t"])
    cells = min(total, max(8, (ends["n"] + draws) // cell_rows))
    spans = rank_table(df.where("weight > 0").select("row_id", "weight"), "row_id", [], (F.sum("weight").alias("w"),), running=("w",))
    lo, hi = F.col("_upto_w") - F.col("w"), F.col("_upto_w")
    # cell c holds the numbers from c * total / cells, rounded up, on
    cell_of = lambda x: F.expr(f"CAST(({{}}) * CAST({cells} AS DECIMAL(20,0)) AS DECIMAL(38,0)) DIV CAST({total} AS DECIMAL(20,0))".format(x))
    span = spans.select("row_id", lo.cast("decimal(20,0)").alias("lo"), hi.cast("decimal(20,0)").alias("hi"))
    reach = span.withColumn("cell", F.explode(F.sequence(cell_of("lo"), cell_of("hi - 1"))))
    stands = reach.select("cell", F.col("lo").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("draw"), "row_id")
    u = uniform_of(F.concat(F.lit("draw|"), F.col("id").cast("string")))
    wanted = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(u * F.lit(float(total))).cast("decimal(20,0)").alias("at"))
    asked = wanted.select(cell_of("at").alias("cell"), F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), "draw", F.lit(None).cast(df.schema["row_id"].dataType).alias("row_id"))
    line = Window.partitionBy("cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stands.unionByName(asked).withColumn("row_id", F.last("row_id", ignorenulls=True).over(line))
    return found.where("kind = 1").select("draw", "row_id")


def plateau_rates(df: DataFrame, first: float, factor: float = 0.5, patience: int = 5) -> DataFrame:
    """(run, epoch, rate): the rate falls by ``factor`` after more than ``patience`` epochs without a better metric.

    The state runs from epoch to epoch, so each run is a group of its own.
    """

    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        best, bad, rate, out = float("-inf"), 0, first, []
        for m in pdf["metric"].tolist():
            bad = 0 if m > best else bad + 1
            best = max(best, m)
            if bad > patience:
                rate, bad = rate * factor, 0
            out.append(rate)
        return pdf[["run", "epoch"]].assign(rate=out)

    return df.groupBy("run").applyInPandas(schedule, "run long, epoch int, rate double")
