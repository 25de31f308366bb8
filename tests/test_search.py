import random

from pyspark.sql import functions as F

from plumbline.operators.search import halved, search


def plain(rows, rungs, eta):
    out = {}
    for study in {r[0] for r in rows}:
        left = sorted({r[1] for r in rows if r[0] == study})
        for rung in rungs:
            best = {a: max((m for s, x, e, m in rows if (s, x) == (study, a) and e <= rung and m is not None and m == m), default=float("-inf")) for a in left}
            order = sorted(left, key=lambda a: (-best[a], a))
            keep = -(-len(order) // eta)
            out |= {(study, a): rung for a in order[keep:]}
            left = order[:keep]
        out |= {(study, a): None for a in left}
    return out


def test_arms_stop_where_a_plain_version_stops_them(spark):
    r = random.Random(0)
    rows = [(s, a, e, r.choice([None, float("nan"), round(r.random(), 1), r.random()])) for s in "xy" for a in range(13) for e in range(1, 1 + r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "study string, arm long, epoch int, metric double")
    for rungs, eta in (([1, 2, 4], 2), ([2, 6], 3), ([1], 1)):
        got = {(q["study"], q["arm"]): q["stopped"] for q in halved(df, rungs, eta).collect()}
        assert got == plain(rows, rungs, eta)
    low = {(q["study"], q["arm"]): q["stopped"] for q in halved(df, [1, 3], 2, lower_is_better=True).collect()}
    assert low == plain([(s, a, e, None if m is None else -m) for s, a, e, m in rows], [1, 3], 2)


def test_only_arms_that_are_left_are_fitted(spark):
    asked = []

    def fit(arms, first, last):
        asked.append((arms, first, last))
        epochs = spark.range(first + 1, last + 1).select(F.col("id").cast("int").alias("epoch"))
        return spark.createDataFrame([(a,) for a in arms], "arm long").crossJoin(epochs).withColumn("metric", F.col("arm") * F.col("epoch") / F.lit(10.0))

    history, left = search(fit, list(range(8)), [1, 3, 9])
    assert asked == [(list(range(8)), 0, 1), ([4, 5, 6, 7], 1, 3), ([6, 7], 3, 9)] and left == [7]
    assert history.count() == 8 + 4 * 2 + 2 * 6
