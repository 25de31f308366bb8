"""Operator 4: toxicity by cumulative-link ordinal regression.

P(grade <= j) = logistic(cut_j - x.w) with one weight vector for all ordered cuts; the output is the expected grade. The
sparse features are words (lower case, split at all ASCII but letters and digits) whose presence is clearly more or less
frequent in documents labelled toxic. Labels are only 0 or 1, so among toxic documents the grade is 2 where at least the
median number of toxic-leaning features occurs, else 1.

Fitting uses a bounded sample: at most about ``per_class`` labelled documents of each label, those of least hash, whole
texts; examples are weighted back to the label counts. What reaches the driver is a row per feature (``features`` at
most) and the sample's feature numbers. Scoring covers every row with that small model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import written
from .words import LETTERS, Words, slices


@dataclass(frozen=True)
class OrdinalModel:
    """``words``: sorted 64-bit hashes of the features; ``weights`` for each; ``cuts``: ascending thresholds."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected grade, most likely grade, P(grade >= 1)) of linear scores."""
        upto = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -40, 40)))
        p = np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1), axis=1)
        return p @ np.arange(p.shape[1]), p.argmax(axis=1), 1 - upto[:, 0]


def _features(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) numbers of the features that occur, each pair once."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(texts):
        w = Words(texts.slice(a, b - a), lower=True, gap=LETTERS)
        at = np.minimum(np.searchsorted(words, w.hashes), max(0, len(words) - 1))
        hit = np.flatnonzero(words[at] == w.hashes) if len(words) else np.zeros(0, np.int64)
        doc = np.searchsorted(w.first + w.counts, hit, side="right")
        pair = np.unique(doc * max(1, len(words)) + at[hit])
        rows.append(pair // max(1, len(words)) + a)
        cols.append(pair % max(1, len(words)))
    return np.concatenate(rows), np.concatenate(cols)


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, l2: float = 0.1, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that maximise the weighted likelihood less ``l2`` / 2 |w|^2, by full-batch Adam from zero.

    Cuts are cut_1 plus positive gaps, so they stay ordered. Grades that don't occur only push their cuts apart.
    """
    n, d = x.shape
    theta = np.concatenate([np.zeros(d + 1), np.zeros(grades - 2)])
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), max(1.0, float(weight.sum()))
    for t in range(1, steps + 1):
        gaps = np.exp(np.clip(theta[d + 1 :], -10, 10))
        cuts = theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        upto = 1 / (1 + np.exp(-np.clip(cuts[None, :] - (x @ theta[:d])[:, None], -40, 40)))
        edge = np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1)
        p = np.maximum(np.take_along_axis(edge, y[:, None] + 1, 1) - np.take_along_axis(edge, y[:, None], 1), 1e-9)[:, 0]
        slope = upto * (1 - upto)
        d_cut = np.zeros_like(upto)
        for j in range(grades - 1):
            d_cut[:, j] = slope[:, j] * ((y == j).astype(float) - (y == j + 1)) * weight / p
        grad_cut = -d_cut.sum(axis=0)
        grad = np.concatenate([x.T @ d_cut.sum(axis=1) + l2 * theta[:d], [grad_cut.sum()], [grad_cut[j + 1 :].sum() * gaps[j] for j in range(grades - 2)]]) / total
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(theta[d + 1 :], -10, 10)))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, features: int = 512, least_df: int = 5, lift: float = 3.0) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents.

    A document with several labels counts as toxic if any says so; null ids and labels are left out. Rows of a doc_id
    that repeat are examples of their own, equal ones one example; the sample has about twice ``per_class`` rows of a
    label at most. Without both labels the model has no features and calls nothing toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0, 21.0]))
    if len(sizes) < 2:
        return none
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(" OR ".join(f"toxic = {k}" for k in sizes)).where(share < F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0])))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample, _ = written(sample.dropDuplicates(["doc_id", "toxic", "text"]).withColumn("h", F.xxhash64("text", "doc_id")), "toxicity-sample")  # about 2 * per_class ids were broadcast for it
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    sample = sample.where(part < F.when(F.col("toxic") == 1, 2 * per_class / rows.get(1, 1)).otherwise(2 * per_class / rows.get(0, 1))).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for a, b in slices(batch.column(1)):
                w = Words(batch.column(1).slice(a, b - a), lower=True, gap=LETTERS)
                doc = np.repeat(np.arange(b - a), w.counts)
                order = np.lexsort((doc, w.hashes))
                h, d = w.hashes[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
                h, t = h[new], toxic[a:b][d[new]]
                word, inverse = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(inverse, 1 - t, len(word)).astype(np.int64)), pa.array(np.bincount(inverse, t, len(word)).astype(np.int64))], ["word", "clean", "toxic"])

    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(taken) < 2:
        return none
    n0, n1 = float(taken[0]), float(taken[1])
    df = sample.mapInArrow(count, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= least_df)
    ratio = ((F.col("t") + 0.5) / (n1 + 1)) / ((F.col("c") + 0.5) / (n0 + 1))
    all_ = F.col("c") + F.col("t")
    chi2 = (n0 + n1) * (F.col("t") * (n0 - F.col("c")) - F.col("c") * (n1 - F.col("t"))) ** 2 / (all_ * (n0 + n1 - all_ + 0.5) * n0 * n1)
    picked = df.withColumn("ratio", ratio).withColumn("chi2", chi2).where((F.col("chi2") > 20) & ((F.col("ratio") > lift) | (F.col("ratio") < 1 / lift))).orderBy(F.col("chi2").desc(), "word").limit(features).collect()
    words = np.array([r["word"] for r in picked], np.int64).view(np.uint64)
    order = np.argsort(words)
    words, leans = words[order], np.array([r["ratio"] > 1 for r in picked], bool)[order]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = _features(batch.column(1), words)
            own = [cols[rows == k].tolist() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], ["toxic", "features"])

    rows = sorted(sample.mapInArrow(found, "toxic int, features array<int>").collect(), key=lambda r: (r["toxic"], r["features"]))
    x, toxic = np.zeros((len(rows), len(words))), np.array([r["toxic"] for r in rows])
    for k, r in enumerate(rows):
        x[k, r["features"]] = 1
    leaning = x[:, leans].sum(axis=1)
    some = leaning[(toxic == 1) & (leaning > 0)]
    grade = np.where(toxic == 0, 0, np.where(leaning >= max(2.0, float(np.median(some)) if len(some) else 2.0), 2, 1))
    weight = np.where(toxic == 1, sizes[1] / n1, sizes[0] / n0)
    weights, cuts = fit_ordinal(x, grade, weight, 3)
    return OrdinalModel(words, weights, cuts)


def severity(model: OrdinalModel, text: Column) -> Column:
    """A struct (expected_severity, severity_grade, p_toxic) for each text; null and empty texts have no features."""

    @F.pandas_udf("expected_severity double, severity_grade int, p_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, pa.string(), from_pandas=True)
        rows, cols = _features(column, model.words)
        linear = np.bincount(rows, model.weights[cols], len(texts)) if len(rows) else np.zeros(len(texts))
        mean, grade, p = model.expected(linear)
        return pd.DataFrame({"expected_severity": mean, "severity_grade": grade.astype(np.int32), "p_toxic": p})

    return score(text)


def is_toxic(model: OrdinalModel, text: Column, at_least: float = 0.5) -> Column:
    """Whether P(grade >= 1) is ``at_least`` for a text; false for null and empty ones."""
    return severity(model, text.cast("string"))["p_toxic"] >= at_least


def score_toxicity(docs: DataFrame, model: OrdinalModel, at_least: float = 0.5) -> DataFrame:
    """``docs`` with one more struct column ``_toxicity`` (expected_severity, severity_grade, p_toxic, toxic).

    All rows and columns stay; a column of that name is replaced. ``toxic`` is P(grade >= 1) >= ``at_least``.
    """
    scored = docs.withColumn("_toxicity", severity(model, F.col("text").cast("string")))
    return scored.withColumn("_toxicity", F.col("_toxicity").withField("toxic", F.col("_toxicity.p_toxic") >= at_least))
