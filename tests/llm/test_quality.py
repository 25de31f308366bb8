import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm.quality import STATISTICS, Trees, cut_points, fit_quality, fit_trees, held_out, quality_score, statistics


def plain_tree(x, g, h, cuts, depth, rate, l2, least):
    """Leaf value of each row, by trying every cut of every column on the rows of a node."""
    out = np.zeros(len(x))

    def grow(rows, level):
        sg, sh = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        for f in range(x.shape[1]) if level < depth else ():
            for cut in cuts[f]:
                left = x[rows, f] <= cut
                hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                if hl >= least and hr >= least:
                    gain = g[rows][left].sum() ** 2 / (hl + l2) + g[rows][~left].sum() ** 2 / (hr + l2) - sg**2 / (sh + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        if best[1] is None:
            out[rows] = -rate * sg / (sh + l2)
        else:
            left = x[rows, best[1]] <= best[2]
            grow(rows[left], level + 1)
            grow(rows[~left], level + 1)

    grow(np.arange(len(x)), 0)
    return out


def test_trees_equal_a_plain_version():
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = (x[:, 0] * x[:, 1] + 0.3 * r.normal(size=300) > 0).astype(float)
    got = fit_trees(x, y, rounds=6, depth=3).margins(x)
    margin, cuts = np.full(300, np.log(y.mean() / (1 - y.mean()))), cut_points(x)
    for _ in range(6):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + plain_tree(x, p - y, p * (1 - p), cuts, 3, 0.1, 1.0, 2.0)
    assert np.abs(got - margin).max() < 1e-9


def test_flat_trees_walk_like_single_rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3))
    m = fit_trees(x, (x[:, 0] > x[:, 1]).astype(float), rounds=5, depth=4)
    for row, told in zip(x, m.margins(x), strict=True):
        total = m.base
        for s, c, v in zip(m.statistic, m.threshold, m.value, strict=True):
            at = 0
            while s[at] >= 0:
                at = 2 * at + 1 + int(row[s[at]] > c[at])
            total += v[at]
        assert abs(total - told) < 1e-12


def test_statistics_of_known_texts():
    texts = ["", None, "One two two\nTHREE | three.\nOne two two\n", "x" * 300_000, "\n \n", "é"]
    got = np.vstack([x for _, x in statistics(pa.array(texts))])
    assert got.shape == (len(texts), len(STATISTICS)) and np.isfinite(got).all()
    assert (got[0] == 0).all() and (got[1] == 0).all()
    row = dict(zip(STATISTICS, got[2], strict=True))
    t = texts[2]
    assert np.isclose(row["bytes"], np.log1p(len(t))) and np.isclose(row["words"], np.log1p(9)) and row["lines"] == np.log1p(3)
    assert np.isclose(row["upper"], sum(c.isupper() for c in t) / len(t)) and np.isclose(row["bar"], 1 / len(t))
    assert np.isclose(row["distinct_words"], 5 / 9) and np.isclose(row["commonest_word"], 4 / 9) and np.isclose(row["distinct_lines"], 2 / 3)
    assert np.isclose(row["shouted_words"], 1 / 9) and np.isclose(row["capital_words"], 3 / 9) and np.isclose(row["longest_word"], 6) and np.isclose(row["distinct_pairs"], 6 / 8)
    assert dict(zip(STATISTICS, got[3], strict=True))["longest_word"] == 300_000


def made(n=900, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6)) + "."
    bad = lambda: " | ".join(word() + r.choice(["", "###", "!!"]) for _ in range(50))
    return [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]


def test_held_out_rows_are_told_apart(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "q", 5) for i, t, _ in rows], "doc_id long, text string, quality string, good int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = fit_quality(docs.where(~held_out(F.col("doc_id"))), labels, rounds=30)
    got = {r["doc_id"]: (r["h"], r["s"]) for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h"), quality_score(model, F.col("text")).alias("s")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _) in got.items())
    assert sum((got[i][1] > 0.5) == (q == 1) for i, _, q in rows if got[i][0]) >= 0.97 * sum(got[i][0] for i, _, _ in rows)


def test_sample_is_bounded_where_one_id_has_a_third_of_the_rows(spark, monkeypatch):
    rows = made(1200)
    docs = spark.createDataFrame([(0 if k % 3 == 1 else i, t + f" {i}") for k, (i, t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 60] + [(0, 0), (0, None), (None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr("plumbline.llm.quality.fit_trees", lambda x, y, **_: seen.append((len(y), y.sum())) or Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 0, 0.0))
    fit_quality(docs, labels, per_class=20)
    assert seen and seen[0][0] - seen[0][1] <= 40 and seen[0][1] <= 40


def test_no_labels_empty_and_odd_texts(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["s"] for r in docs.select(quality_score(fit_quality(docs, none), F.col("text")).alias("s")).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, quality int")
    assert all(r["s"] > 0.9 for r in docs.select(quality_score(fit_quality(docs, one), F.col("text")).alias("s")).collect())
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(60)], "doc_id long, quality int")
    got = docs.select("text", quality_score(fit_quality(docs, labels, rounds=5), F.col("text")).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r["s"] <= 1 for r in got)
    assert len({r["s"] for r in got if not r["text"]}) == 1
    assert empty.select(quality_score(fit_quality(empty, labels), F.col("text")).alias("s")).count() == 0
