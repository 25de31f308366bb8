"""Operator 11: a quality classifier of histogram gradient-boosted trees over document statistics.

Each whole text becomes a fixed row of statistics (sizes, shares of byte classes, word and line shapes, repetition). Trees
are fitted on a bounded, documented sample of labelled rows: statistics are cut into at most ``BINS`` bins, each level of
a tree sums gradients and Hessians by (node, statistic, bin), and the best split of a node is read off the sums. Fitted
trees are flattened into one array each for statistic, threshold and value, children of node i at 2i + 1 and 2i + 2, and
all rows of a batch walk down a tree together.

Null and empty texts have statistics of 0 and are scored like all others. Equal texts get equal scores. Repeated ids are
rows of their own. Without both labels every text scores the share of good labels, or 0.5 where there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import drop, written
from .words import Words, slices

BINS = 64
_LINES = np.zeros(256, bool)
_LINES[10] = True


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_BYTES = np.arange(256)
CLASSES = {
    "lower": (_BYTES >= 97) & (_BYTES <= 122), "upper": (_BYTES >= 65) & (_BYTES <= 90), "digit": (_BYTES >= 48) & (_BYTES <= 57), "wide": _BYTES >= 128,
    "gap": _bytes(" \t\n\r\v\f"), "line": _bytes("\n"), "stop": _bytes(".?"), "comma": _bytes(",;:"), "bang": _bytes("!"), "bar": _bytes("|"), "sign": _bytes("#$%&*@^~+=_"),
    "bracket": _bytes("<>{}[]()"), "slash": _bytes("/\\"), "quote": _bytes("\"'`-"), "control": (_BYTES < 32) & ~_bytes("\t\n\r\v\f"),
}
_SHARES = np.stack([c.astype(np.float64) for c in CLASSES.values()], axis=1)
STATISTICS = [
    "bytes", *CLASSES, "byte_entropy", "words", "word_bytes", "longest_word", "distinct_words", "commonest_word", "distinct_pairs", "capital_words", "shouted_words", "word_ends",
    "lines", "line_bytes", "distinct_lines", "line_stops", "line_letters",
]


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents the number of distinct keys and how often its commonest one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, d[new], np.diff(np.append(new, len(k))))
    return np.bincount(d[new], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, statistics) of consecutive rows, a row of :data:`STATISTICS` for each text, whole texts."""
    for a, b in slices(texts):
        part, n = texts.slice(a, b - a), b - a
        w, lines = Words(part), Words(part, gap=_LINES)
        size = np.diff(w.offsets)
        row = np.repeat(np.arange(n, dtype=np.int64), size)
        seen = np.bincount(row * 256 + w.data, minlength=n * 256).reshape(n, 256).astype(np.float64)
        some = np.maximum(size, 1)[:, None]
        share = seen / some
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        of, many = np.repeat(np.arange(n), w.counts), np.maximum(w.counts, 1)
        length = w.to - w.at
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        kinds, common = _distinct(of, w.hashes, n)
        inner = of[1:] == of[:-1]
        pairs, _ = _distinct(of[1:][inner], w.grams(2)[inner], n) if len(of) > 1 else (np.zeros(n), None)
        small = np.concatenate([[0], np.cumsum(CLASSES["lower"][w.data])])
        great = np.concatenate([[0], np.cumsum(CLASSES["upper"][w.data])])
        shouted = (small[w.to] == small[w.at]) & (great[w.to] > great[w.at])
        per = lambda hit, m=many, o=of: np.bincount(o, hit, n) / m
        letter = CLASSES["lower"] | CLASSES["upper"] | CLASSES["wide"]
        line_of, line_many = np.repeat(np.arange(n), lines.counts), np.maximum(lines.counts, 1)
        line_kinds, _ = _distinct(line_of, lines.hashes, n)
        ends = w.data[lines.to - 1]
        columns = [
            np.log1p(size), *(seen @ _SHARES / some).T, entropy, np.log1p(w.counts), per(length), longest, kinds / many, common / many, pairs / np.maximum(w.counts - 1, 1), per(CLASSES["upper"][w.data[w.at]]), per(shouted), per(~letter[w.data[w.to - 1]]),
            np.log1p(lines.counts), np.bincount(line_of, lines.to - lines.at, n) / line_many, line_kinds / line_many, per(CLASSES["stop"][ends], line_many, line_of), per(letter[ends], line_many, line_of),
        ]
        yield a, np.stack(columns, axis=1)


@dataclass(frozen=True)
class Trees:
    """Flattened trees: arrays of trees x nodes. A node with statistic -1 is a leaf; its children repeat its value."""

    statistic: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of leaf values of each row; all rows go down a tree together, left where x <= threshold."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for stat, cut, value in zip(self.statistic, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                s = stat[at]
                at = np.where(s < 0, at, 2 * at + 1 + (x[rows, s] > cut[at]))
            total += value[at]
        return total


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column at most ``bins`` - 1 cuts: quantiles of its values, halfway to the next value up."""
    out = []
    for col in x.T:
        v = np.unique(col)
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(v) > bins else v[:-1]
        nxt = v[np.minimum(np.searchsorted(v, q, "right"), len(v) - 1)]
        out.append(((q + nxt) / 2)[nxt > q])
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 150, depth: int = 5, rate: float = 0.1, l2: float = 1.0, least: float = 2.0, bins: int = BINS) -> Trees:
    """Logistic boosting of ``rounds`` trees. A split needs a Hessian of ``least`` on both sides; equal gains go to the first statistic and cut."""
    n, d = x.shape
    cuts = cut_points(x, bins)
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    flat = binned + np.arange(d) * bins
    nodes = (2 << depth) - 1
    share = float(y.mean())
    base = float(np.log(share / (1 - share)))
    margin, trees = np.full(n, base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        stat, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        for level in range(depth + 1):
            first, wide = (1 << level) - 1, 1 << level
            own = at >= first  # rows of leaves further up stay there
            sums_g, sums_h = (np.bincount(at[own] - first, v[own], wide) for v in (g, h))
            value[first : first + wide] = -rate * sums_g / (sums_h + l2)
            if level == depth:
                break
            key = ((at[own] - first)[:, None] * (d * bins) + flat[own]).ravel()
            hist = [np.bincount(key, np.repeat(v[own], d), wide * d * bins).reshape(wide, d, bins).cumsum(axis=2)[:, :, :-1] for v in (g, h)]
            rest = [sums_g[:, None, None] - hist[0], sums_h[:, None, None] - hist[1]]
            gain = hist[0] ** 2 / (hist[1] + l2) + rest[0] ** 2 / (rest[1] + l2) - (sums_g**2 / (sums_h + l2))[:, None, None]
            usable = (hist[1] >= least) & (rest[1] >= least) & (np.arange(bins - 1)[None, None, :] < np.array([len(c) for c in cuts])[None, :, None])
            gain = np.where(usable, gain, -1.0).reshape(wide, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(wide), best] > 1e-9):
                f, c = divmod(int(best[k]), bins - 1)
                stat[first + k], cut[first + k] = f, cuts[f][c]
            split = own & (stat[at] >= 0)
            at[split] = 2 * at[split] + 1 + (x[split, stat[at[split]]] > cut[at[split]])
        margin += value[at]
        trees.append((stat, cut, value))
    stat, cut, value = (np.stack(t) for t in zip(*trees, strict=True))
    return Trees(stat, cut, value, depth, base)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out (and not learnt from either)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 6000, **settings) -> Trees:
    """Fit on at most ``per_class`` labelled ids and then twice as many rows of each label, those of least hash.

    A document with several labels is good if any says so; null ids and labels are left out, and labels without a
    document teach nothing. The sample is rows of statistics, never texts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("good"))
    ids = None
    for k in (0, 1):
        own = known.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = own if ids is None else ids.unionByName(own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(ids), "doc_id").select("good", F.xxhash64("doc_id", "text").alias("h"), "text")  # the ids are at most 2 * per_class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in statistics(batch.column(2)):
                vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(x)), batch.column(1).slice(a, len(x)), vec], ["good", "h", "x"])

    told, at = written(sample.mapInArrow(run, "good int, h long, x array<double>"), "quality-sample")
    taken = [r for k in (0, 1) for r in told.where(F.col("good") == k).orderBy("h").limit(2 * per_class).toArrow().to_pylist()]
    drop(docs.sparkSession, at)
    y = np.array([r["good"] for r in taken], float)
    if len(set(y)) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 0, float(np.log(share / (1 - share))))
    return fit_trees(np.array([r["x"] for r in taken]), y, **settings)


def quality_score(model: Trees, text: Column) -> Column:
    """The probability, between 0 and 1, that a text is good."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for a, x in statistics(pa.array(texts, pa.string(), from_pandas=True)):
            out[a : a + len(x)] = 1 / (1 + np.exp(-model.margins(x)))
        return pd.Series(out)

    return score(text.cast("string"))
