import numpy as np
import pytest

from plumbline.operators.intervals import multiplicities, paired_metric_interval


def plain(metric, y, score, times):
    """From rows written out as often as they count."""
    y, score = np.repeat(y, times), np.repeat(score, times)
    if not 0 < y.sum() < len(y):
        return np.nan
    if metric == "auroc":
        a, b = score[y == 1], score[y == 0]
        return ((a[:, None] > b[None, :]) + (a[:, None] == b[None, :]) / 2).mean()
    out = 0.0
    for s in np.unique(score):
        out += (y[score == s].sum() / y.sum()) * y[score >= s].mean()
    return out


@pytest.mark.parametrize("metric", ["auroc", "average_precision"])
@pytest.mark.parametrize("ranges", [32, 64])
def test_all_resamples_equal_rows_written_out(spark, metric, ranges):
    r = np.random.default_rng(0)
    rows = [(k, int(r.random() < 0.4), int(r.integers(0, 12)), float(np.round(r.normal(), 1)), float(np.round(r.normal(), 2))) for k in ("a", "b", None) for _ in range(150)] + [("one", 1, 1, 0.5, 0.2), ("a", None, 1, 0.1, 0.1), ("a", 1, 1, None, 0.1)]
    df = spark.createDataFrame(rows, "k string, y int, user long, ref double, cmp double").repartition(4)
    got = {x["k"]: x for x in paired_metric_interval(df, ["k"], "user", "ref", "cmp", metric, resamples=40, ranges=ranges).collect()}
    assert set(got) == {"a", "b", None, "one"} and np.isnan(got["one"]["delta"]) and got["one"]["favours"] == "neither"
    hashes = {x["user"]: x["h"] for x in df.selectExpr("user", "xxhash64(user) AS h").distinct().collect()}
    for k in ("a", "b", None):
        own = [x for x in rows if x[0] == k and x[1] is not None and x[3] is not None]
        y, ref, cmp = (np.array([x[i] for x in own]) for i in (1, 3, 4))
        times = multiplicities(np.array([hashes[x[2]] for x in own]), 40).astype(int)
        deltas = np.array([plain(metric, y, ref, t) - plain(metric, y, cmp, t) for t in times.T])
        assert got[k]["delta"] == pytest.approx(deltas[0]) and got[k]["reference"] == pytest.approx(plain(metric, y, ref, times[:, 0]))
        low, high = np.nanquantile(deltas[1:], [0.025, 0.975])
        assert got[k]["low"] == pytest.approx(low) and got[k]["high"] == pytest.approx(high)


def test_multiplicities_are_poisson():
    m = multiplicities(np.arange(500), 400)
    assert (m[:, 0] == 1).all() and abs(m[:, 1:].mean() - 1) < 0.02 and abs(m[:, 1:].var() - 1) < 0.03
    assert abs(np.corrcoef(m[:, 1:100].T.astype(float))[0, 1:].mean()) < 0.03
