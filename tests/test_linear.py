import numpy as np
import pytest

from plumbline.operators import linear as L
from plumbline.operators.orderstats import exact_percentile


def data(n=200, d=6, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * r.uniform(0.1, 20, d) + r.normal(size=d) * 3
    x[:, d - 1] = 4.0
    return x, r


def table(spark, x, y):
    return spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(len(y))], "row_id long, y double, values array<double>").repartition(3)


def test_ridge_equals_the_closed_form(spark):
    x, r = data()
    y = x[:, 0] - 2 * x[:, 1] + r.normal(size=len(x)) + 50
    s = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = (x - x.mean(axis=0)) / s
    want = y.mean() + z @ np.linalg.solve(z.T @ z + 10 * np.eye(6), z.T @ (y - y.mean()))
    got = {q["row_id"]: q["score"] for q in L.fit_ridge(table(spark, x, y)).scores(table(spark, x, y)).collect()}
    assert np.abs(np.array([got[i] for i in range(len(y))]) - want).max() < 1e-8


@pytest.mark.parametrize(("c", "centre"), [(0.5, True), (1.0, False)])
def test_logistic_equals_plain_descent(spark, c, centre):
    x, r = data()
    y = (x[:, 0] / x[:, 0].std() + r.normal(size=len(x)) > 1).astype(float)
    s = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = np.column_stack([(x - (x.mean(axis=0) if centre else 0)) / s, np.ones(len(x))])
    weight = c * np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    theta = np.zeros(7)
    step = 1 / (1 + 0.25 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2)
    for _ in range(60_000):
        theta -= step * (theta + z.T @ (weight * (1 / (1 + np.exp(-z @ theta)) - y)))
    got = {q["row_id"]: q["score"] for q in L.fit_logistic(table(spark, x, y), c, centre).scores(table(spark, x, y)).collect()}
    assert np.abs(np.array([got[i] for i in range(len(y))]) - 1 / (1 + np.exp(-z @ theta))).max() < 1e-6


def test_one_class_is_refused(spark):
    x, _ = data(20)
    with pytest.raises(ValueError, match="both classes"):
        L.fit_logistic(table(spark, x, np.ones(20)))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.25, 0.999, 1.0])
def test_percentiles_are_exact(spark, q):
    r = np.random.default_rng(1)
    groups = {"a": r.normal(size=501), "b": np.round(r.normal(size=200), 1), "c": np.array([3.0]), None: r.normal(size=64) * 10.0 ** r.integers(-300, 300, 64), "d": np.array([-np.inf, 1.0, 2.0]), "e": np.full(90, 7.25)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {t["k"]: t["p"] for t in exact_percentile(df, "x", ["k"], q, bins=8).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        v = np.sort(vs)
        at = (len(v) - 1) * q
        a, b = v[int(np.floor(at))], v[int(np.ceil(at))]
        want = a if a == b else a + (b - a) * (at - np.floor(at))
        assert got[k] == pytest.approx(want, rel=1e-12) or (np.isnan(want) and np.isnan(got[k]))
    finite = [v for k, v in rows if v is not None and k == "a" and v == v]
    alone = exact_percentile(df.where("k = 'a'"), "x", [], q).collect()
    assert alone[0]["p"] == pytest.approx(np.quantile(finite, q), rel=1e-12)
    assert exact_percentile(df.where("k = 'none'"), "x", [], q).count() == 0
