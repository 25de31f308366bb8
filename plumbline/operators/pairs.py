"""Operators on pairs of rows within a batch, and batch losses.

All-pair forms are for training batches: with ``size`` they deal a whole table into batches of so many rows and pair rows
within each; else the table is one batch of at most ``most`` rows, and they fail beyond. Rank forms (AUROC from average
ranks, Spearman from rank correlation) compare the rows of a whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import sigmoid, softplus


def _batch(df: DataFrame, most: int) -> DataFrame:
    n = len(df.limit(most + 1).select(F.lit(1)).collect())
    if n > most:
        raise ValueError(f"more than {most} rows in a batch; use the rank forms for tables")
    return df.withColumn("_batch", F.lit(0))


def batches(df: DataFrame, size: int = 64, cell_rows: int = 50_000) -> DataFrame:
    """Adds ``_batch``: all rows in hash order, ``size`` to a batch, the last one with what is left.

    Positions come from a window within each hash cell of about ``cell_rows`` rows and the sums of the cells before it.
    """
    columns = df.columns
    cells = max(1, -(-df.count() // cell_rows))
    rows = df.withColumn("_h", F.xxhash64(*columns)).withColumn("_cell", F.pmod("_h", F.lit(cells)))
    upto = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_cell"))  # a row for each cell
    starts = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).select("_cell", (upto - F.col("_n")).alias("_base"))
    at = F.col("_base") + F.row_number().over(Window.partitionBy("_cell").orderBy("_h", *columns)) - 1
    return rows.join(F.broadcast(starts), "_cell").withColumn("_batch", F.floor(at / size)).select(*columns, "_batch")


def _batched(df: DataFrame, most: int, size: int | None, by: Column | None) -> DataFrame:
    return df.withColumn("_batch", by) if by is not None else batches(df, size) if size else _batch(df, most)


def margin_losses(df: DataFrame, most: int = 1024, size: int | None = None, by: Column | None = None) -> DataFrame:
    """(pos_id, neg_id, loss): softplus of the negative margin of each positive and negative of a batch (row_id, y, score).

    ``by`` is the number of a row's training batch where the table tells it.
    """
    b = _batched(df, most, size, by)
    pos = b.where("y = 1").select("_batch", F.col("row_id").alias("pos_id"), F.col("score").alias("_p"))
    neg = b.where("y = 0").select("_batch", F.col("row_id").alias("neg_id"), F.col("score").alias("_n"))
    return pos.join(neg, "_batch").select("pos_id", "neg_id", softplus(F.col("_n") - F.col("_p")).alias("loss"))


def soft_ranks(df: DataFrame, temperature: float = 1.0, most: int = 1024, size: int | None = None, by: Column | None = None) -> DataFrame:
    """(row_id, soft_rank): 1 plus the sum of sigmoids of score differences to the other rows of a batch."""
    b = _batched(df, most, size, by)
    other = b.select("_batch", F.col("row_id").alias("_o"), F.col("score").alias("_s"))
    term = F.when(F.col("row_id") == F.col("_o"), 0.0).otherwise(sigmoid((F.col("score") - F.col("_s")) / temperature))
    return b.join(other, "_batch").groupBy("_batch", "row_id").agg((1 + F.sum(term)).alias("soft_rank")).drop("_batch")


def head_cosines(df: DataFrame) -> DataFrame:
    """(head_a, head_b, cosine2) of each pair of heads over (row_id, head, v): a row's heads meet as one array, unpaired rows count as 0."""
    rows = df.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("head", "v"))).alias("h"))
    a = rows.select("h", F.explode("h").alias("a"))
    both = a.select("a", F.explode("h").alias("b")).where(F.col("a.head") < F.col("b.head"))
    s = lambda x, y: F.sum(F.col(x) * F.col(y))
    dots = both.groupBy(F.col("a.head").alias("head_a"), F.col("b.head").alias("head_b"))
    return dots.agg((F.pow(s("a.v", "b.v"), F.lit(2.0)) / (s("a.v", "a.v") * s("b.v", "b.v"))).alias("cosine2"))


def cross_entropy(y: Column, p: Column) -> Column:
    return -F.log(F.when(y == 1, p).otherwise(1 - p))


def focal(y: Column, p: Column, gamma: float = 2.0) -> Column:
    q = F.when(y == 1, p).otherwise(1 - p)
    return -F.pow(1 - q, F.lit(gamma)) * F.log(q)


def smooth_l1(error: Column, beta: float = 1.0) -> Column:
    return F.when(F.abs(error) < beta, 0.5 * error * error / beta).otherwise(F.abs(error) - 0.5 * beta)


def losses(df: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """Mean losses of (y, s, t): y and the logit s, and the regression error s - t."""
    p, e = sigmoid(F.col("s")), F.col("s") - F.col("t")
    each = {"cross_entropy": cross_entropy(F.col("y"), p), "focal": focal(F.col("y"), p), "smooth_l1": smooth_l1(e), "mse": e * e}
    return df.groupBy(*keys).agg(*[F.round(F.avg(c), digits).alias(k) for k, c in each.items()])


#: Pairs of a batch whose terms are held at once.
PAIRS = 1 << 18


def _sums(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of ``a`` the sum of a term over all of ``b``; as many rows at a time as ``PAIRS`` allows."""
    step = max(1, PAIRS // max(1, len(b)))
    return np.concatenate([np.zeros(0), *(term(a[at : at + step, None], b[None, :]).sum(axis=1) for at in range(0, len(a), step))])


def _batch_losses(y: np.ndarray, s: np.ndarray, t: np.ndarray, margin: float, temperature: float, weights: tuple[float, float]) -> tuple[float | None, ...]:
    """ap_surrogate, auroc_margin, spearman and ranking_mse of one batch; a base loss is None where a class has no probability left."""
    n, pos, neg = len(y), s[y == 1], s[y == 0]
    mse = float(((s - t) ** 2).mean())
    q = 1 / (1 + np.exp(-s))
    q = np.where(y == 1, q, 1 - q)
    focal_ = even_ = None
    if not (q <= 0).any():
        w = np.where(y == 1, weights[1], weights[0])
        ce = -np.log(q) * w
        focal_, even_ = float(((1 - np.exp(-ce)) ** 2 * ce).mean()), float(ce.sum() / w.sum())
        if len(pos) and len(neg):
            each = _sums(neg, pos, lambda v, p: np.maximum(margin - p + v, 0) + np.log1p(np.exp(-np.abs(margin - p + v))))  # of each negative
            hard = np.exp((neg - neg.max()) / temperature)
            pairs = len(pos) * len(neg)
            focal_ = 0.65 * focal_ + 0.35 * float((each * hard).sum() / hard.sum() / pairs)
            even_ = 0.75 * even_ + 0.25 * float(each.sum() / pairs)
    if n < 2:
        return focal_, even_, mse, mse
    centred = []
    for x in (s, t):
        r = _sums(x, x, lambda a, b: 1 / (1 + np.exp(-(a - b) * (10.0 / temperature))))
        centred.append(r - r.mean())
    norms = [float(np.sqrt((r * r).sum())) for r in centred]
    corr = 0.0 if min(norms) < 1e-8 else float((centred[0] * centred[1]).sum()) / (norms[0] * norms[1])
    at = np.arange(n)
    order = float(_sums(at, at, lambda a, c: np.maximum(0.0, 0.1 - np.sign(t[a] - t[c]) * (s[a] - s[c]))).sum())
    order = (order - 0.1 * n) / (n * (n - 1) + 2e-8)  # ordered pairs count each pair twice, and each row with itself gives the margin
    return focal_, even_, 0.1 * mse - corr, 0.5 * mse + 0.5 * order


def ranking_losses(df: DataFrame, by: Column, margin: float = 0.5, temperature: float = 1.0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(batch, n, ap_surrogate, auroc_margin, spearman, ranking_mse) of each training batch of (y, s, t).

    y is 0 or 1, s the score, and s - t the regression error; ``weights`` are those of the classes in the cross entropy.
    A batch, of a bounded number of rows, is one array, and each of its pairs is looked at once a term. The pair terms are
    left out where a batch has no pair of that kind. Rows with a null take no part.
    """
    rows = df.select(by.alias("batch"), F.struct(F.col("y").cast("double").alias("y"), F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t")).alias("r"))
    rows = rows.where("r.y IS NOT NULL AND r.s IS NOT NULL AND r.t IS NOT NULL").groupBy("batch").agg(F.sort_array(F.collect_list("r")).alias("r"))
    names = ("ap_surrogate", "auroc_margin", "spearman", "ranking_mse")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists, out, sizes = part.column(1), [], []
            flat = lists.flatten()
            cols = [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    out.append(_batch_losses(*(c[a:b] for c in cols), margin, temperature, weights))
                    sizes.append(b - a)
            told = [pa.array([o[k] for o in out], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), *told], ["batch", "n", *names])

    schema = T.StructType([rows.schema["batch"], T.StructField("n", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    return rows.mapInArrow(run, schema)
