"""Recorded combination results, guards and invariants."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import recipes as R

HEADS = [[1, 1, 3, 5, 2, 8], [10, 12, 8, 3, 5, 6], [4, 4, 4, 4, 4, 4], [1.0, 1.00000000000001, 1.00000000000002, 1.00000000000003, 1.00000000000004, 1.00000000000005], [8, 3, 2, 1, 4, 4]]
XL, SIDE = [1, 2, 3, 4, 5, 6], [6, 4, 2, 1, 3, 5]


def long(spark, run=1, **streams):
    out = [("seedbag_heads", R.SEED_GROUPS[run][s], i, float(v)) for s, row in enumerate(HEADS) for i, v in enumerate(row)]
    out += [(k, None, i, float(v)) for k, vs in streams.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(out, "component string, seed int, row_id long, score double")


def scores(df):
    return [r["score"] for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("run", [1, 4])
def test_recorded_seed_bags(spark, run):
    got = scores(R.predict(long(spark, run), "clearance_microsome_az", run))
    assert got == pytest.approx([4.8, 4.2, 3.6, 2.8, 3.2, 4.6], abs=1e-12)
    got = scores(R.predict(long(spark, run, fp_only=XL), "ppbr_az", run))
    assert got == pytest.approx([3.66, 3.54, 3.42, 3.16, 3.74, 5.02], abs=1e-12)
    got = scores(R.predict(long(spark, run, xl=XL, descriptor_sidecar_v2=SIDE), "cyp2d6_substrate_carbonmangels", run))
    assert got == pytest.approx([0.07123363301207566, -0.15007587098314815, -0.26977015683606337, -0.3835972831071178, 0.01578291781766687, 0.7226723883822471], abs=1e-12)


def test_recorded_nested_ranks(spark):
    streams = {"c060": [1, 1, 3, 4, 5, 6], "c070": [6, 4, 4, 4, 2, 1], "c008": [2, 6, 1, 2, 5, 3], "kpgt_finetuned": XL, "kpgt_staged": SIDE, "unimol": [10, 12, 8, 3, 5, 6]}
    got = scores(R.predict(long(spark, **streams), "clearance_hepatocyte_az"))
    assert got == pytest.approx([0.45833333333333337, 0.75, 0.29166666666666663, 0.4166666666666667, 0.8333333333333334, 0.75], abs=1e-12)


def test_guards(spark):
    with pytest.raises(ValueError, match="seed_ids"):
        R.predict(long(spark, 2), "clearance_microsome_az", 1)
    with pytest.raises(ValueError, match="run"):
        R.predict(long(spark), "clearance_microsome_az", 0)
    with pytest.raises(ValueError, match="missing"):
        R.predict(long(spark), "clearance_hepatocyte_az")
    uneven = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0)], "component string, row_id long, score double")
    from plumbline.operators.blend import blend

    with pytest.raises(Exception, match="rows"):
        blend(uneven, {"a": 0.5, "b": 0.5}).collect()


def test_lone_prediction_passes(spark):
    df = spark.createDataFrame([("prediction", None, i, i / 3) for i in range(4)], "component string, seed int, row_id long, score double")
    assert scores(R.predict(df, "dili")) == [i / 3 for i in range(4)]


def test_rank_blend_ignores_monotone_maps(spark):
    df = long(spark, a=XL, b=SIDE).where("component IN ('a', 'b')")
    bent = df.withColumn("score", F.exp("score"))
    assert scores(R.predict(df, "vdss_lombardo", names=["a", "b"])) == scores(R.predict(bent, "vdss_lombardo", names=["a", "b"]))


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("one", 1, 0.1), ("one", 1, 0.2), ("tie", 0, 0.5), ("tie", 1, 0.5), ("up", 0, 0.1), ("up", 1, 0.9)], "k string, y int, score double")
    auc = {r["k"]: r["auroc"] for r in M.auroc(df, ["k"]).collect()}
    ap = {r["k"]: r["average_precision"] for r in M.average_precision(df, ["k"]).collect()}
    assert auc["one"] != auc["one"] and auc["tie"] == 0.5 and auc["up"] == 1.0
    assert ap["one"] != ap["one"] and ap["tie"] == 0.5 and ap["up"] == 1.0
    rho = {r["k"]: r["spearman"] for r in M.spearman(df.withColumn("y", F.col("y").cast("double")), ["k"]).collect()}
    assert rho["one"] != rho["one"] and rho["up"] == pytest.approx(1.0)


def test_head_training_lowers_the_loss():
    import numpy as np

    from plumbline.operators.models import forward, fusion_head, train_head

    rng = np.random.default_rng(0)
    xs = [rng.normal(size=(200, 4)), rng.normal(size=(200, 3))]
    y = (xs[0][:, 0] + xs[1][:, 0] > 0).astype(int)
    head, losses = train_head(fusion_head([4, 3], 8, 2), xs, y)
    assert losses[-1] < losses[0] * 0.7
    assert (forward(head, xs).argmax(axis=1) == y).mean() > 0.85


def test_sources(spark, tmp_path):
    from plumbline.sources import tables as S

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "row_id long, values array<double>")
    S.write_features(df, str(tmp_path / "f"), ["a.0", "a.1"])
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_new(df, str(tmp_path / "f" / "matrix"))
    (tmp_path / "t.csv").write_text("smiles,label\nCCO,1\n,0\n")
    rows = S.read_csv(spark, str(tmp_path / "t.csv"), "smiles string, label double", ("smiles",))
    with pytest.raises(Exception, match="null smiles"):
        rows.collect()
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "dili.json").write_text('{"metric": "auroc",\n "seed": 3}')
    assert S.lookup_one(S.read_registry(spark, str(tmp_path / "r")), task="dili").collect()[0]["seed"] == 3
    assert S.split_union({"train": df, "test": df}).groupBy("split").count().count() == 2


def test_bags_are_registered_with_the_recorded_settings(spark, sf_dir, monkeypatch):
    from dataclasses import replace

    from plumbline.operators import models as M
    from plumbline.plans import models as Q

    asked, scored = [], M._scored

    def small(rows, query, members, backend):
        asked.append((backend, [(m.seed, m.columns and len(m.columns)) for m in members]))
        return scored(rows, query, members, replace(backend, **({"rounds": 2} if isinstance(backend, M.Boosting) else {"trees": 2})))

    monkeypatch.setattr(M, "_scored", small)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for f in (Q.fold_bag_gbt, Q.fold_bag_forest, Q.seed_bag_forest, Q.fold_bag_gbt_extended, Q.fold_bag_forest_graded):
        got = [r["score"] for r in f(spark, sf_dir).collect()]
        assert len(got) == n and all(0 <= v <= (9 if "extended" in f.__name__ or "graded" in f.__name__ else 1) for v in got)
    ames, forest, bbb, extended, graded = asked
    assert (ames[0].rounds, ames[0].depth, ames[0].rate, ames[0].rows, ames[0].columns, ames[0].least, ames[0].balanced) == (500, 5, 0.04, 0.85, 0.85, 2, True)
    assert ames[1] == [(s * 100 + k, None) for s in (11, 22, 33, 44, 55) for k in range(3)]
    assert (forest[0].trees, forest[0].leaf, forest[1]) == (900, 2, [(101, None), (102, None), (103, None)])
    assert (bbb[0].trees, bbb[0].leaf, [m for m, _ in bbb[1]]) == (800, 1, [1, 2, 3, 4, 5])
    assert (extended[0].rounds, extended[0].depth, extended[0].l2, extended[0].classification, extended[1][0]) == (600, 5, 2.0, False, (101, 32))
    assert (graded[0].trees, graded[0].leaf, graded[0].classification, graded[1][2]) == (900, 2, False, (103, 32))


def test_models_are_written_once_and_read_if_unchanged(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from plumbline.sources import artifacts as A

    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()]).fit(df)
    A.save_model(model, str(tmp_path / "m"), {"seed": 3})
    back, settings = A.load_model(spark, str(tmp_path / "m"))
    assert settings == {"seed": 3}
    assert [r["prediction"] for r in back.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]
    with pytest.raises(Exception, match="(?i)exist"):
        A.save_model(model, str(tmp_path / "m"), {"seed": 4})
    (tmp_path / "m" / "model" / "metadata" / "more").write_text("x")
    with pytest.raises(ValueError, match="differ"):
        A.load_model(spark, str(tmp_path / "m"))


def test_feature_assembly_rules():
    from plumbline.operators import features as X

    width = lambda p: sum(n for _, n in X.profile_blocks(p))
    assert [width(p) for p in ("core", "descriptors", "erg", "core_path", "wide_chem")] == [2563, 200, 315, 3587, 2563 + 167 + 5 * 1024]
    assert width("xl_full_chemical_prior") == 2563 + 167 + 10 * 2048
    assert X.candidate_blocks("chemberta_kpgt_ept_gated") == ["C", "K", "E"] and X.modality_mask("ept_kpgt") == (False, True, True)
    for f, bad in ((X.profile_blocks, "none"), (X.candidate_blocks, "ept_chemberta"), (X.modality_mask, "none")):
        with pytest.raises(ValueError, match="unknown"):
            f(bad)
    with pytest.raises(ValueError, match="missing blocks"):
        X.assembled({}, ["C"])
    with pytest.raises(ValueError, match="at least one"):
        X.masked_blocks([(F.lit(None), 3)], (False,))


def test_ranks_match_windows_for_nulls_and_ties(spark):
    from plumbline.operators import ranks as K

    data = [(k, None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i * 7 % 17)) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(data, "k string, x double").repartition(3)
    got = K.with_ranks(df, {"x": "r"}, ["k"]).select("k", "x", "r").collect()
    want = df.select("k", "x", K.average_rank("x", ["k"]).alias("r")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(data)


def test_high_percentile_is_exact(spark):
    import numpy as np

    from plumbline.operators.features import high_percentile

    for n in (1, 7, 900, 20_000):
        x = np.random.default_rng(n).lognormal(size=n).round(2)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        assert high_percentile(df, "x", 0.999).collect()[0]["p"] == pytest.approx(np.quantile(x, 0.999), rel=1e-12)
    assert high_percentile(df.where("false"), "x", 0.999).collect()[0]["p"] is None


def circles(spark, n=400):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4))
    return x, (np.linalg.norm(x[:, :2], axis=1) > 1.2).astype(float)


def test_kernel_heads_separate_what_no_line_separates(spark):
    import numpy as np

    from plumbline.operators import models as M

    x, y = circles(spark)
    data = [(i, float(y[i]), [None if (i + j) % 23 == 0 else float("nan") if (i + j) % 29 == 0 else float(v) for j, v in enumerate(x[i])] + [None]) for i in range(400)]
    df = spark.createDataFrame(data, "row_id long, y double, values array<double>")
    medians = M.column_medians(df, "values")
    own = [v[2][1] for v in data if v[2][1] is not None and v[2][1] == v[2][1]]
    assert medians[4] == 0 and medians[1] == np.median(own)
    got = {r["row_id"]: r["score"] for r in M.kernel_heads(df, df, [M.Kernel(0, 2, 10.0, 2.0), M.Kernel(0, 5, 10.0, 1.0), M.Kernel(0, 4, 10.0, 1.0, pca=4)]).collect()}
    s = np.array([got[i] for i in range(400)])
    assert len(got) == 400 and s.min() > 0 and s.max() <= 1
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.9


@pytest.mark.parametrize("balanced", [True, False])
def test_decision_values_equal_an_exact_machine(spark, balanced):
    """The dual problem, solved by coordinate pairs, on 90 rows that are all landmarks; tolerance 0.02."""
    import numpy as np

    from plumbline.operators import kernel as N

    x, y = circles(spark, 90)
    df = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(90)], "row_id long, y double, values array<double>").repartition(3)
    made, weights = N.fit_machines(df, [N.Kernel(0, 4, 1.0, 2.0, None, balanced)], sharp=0.002, most=200)
    got = {r["row_id"]: r["score"] for r in N.decision_values(df, made, weights).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = N.kernel(z, z, 2.0 / 4)
    t = np.where(y > 0, 1.0, -1.0)
    c = np.where(y > 0, 90 / (2 * y.sum()), 90 / (2 * (90 - y.sum()))) if balanced else np.ones(90)
    a, q = np.zeros(90), k * t[:, None] * t[None, :]
    for _ in range(20_000):  # the pair that violates most
        g = (q @ a - 1) * -t
        up, down = np.where(t > 0, a < c, a > 0), np.where(t > 0, a > 0, a < c)
        i, j = np.where(up, g, -np.inf).argmax(), np.where(down, g, np.inf).argmin()
        if g[i] - g[j] < 1e-9:
            break
        most = min(c[i] - a[i] if t[i] > 0 else a[i], a[j] if t[j] > 0 else c[j] - a[j])
        d = min(most, (g[i] - g[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12))
        a[i] += t[i] * d
        a[j] -= t[j] * d
    f = k @ (a * t)
    f = f + (g[i] + g[j]) / 2
    assert np.abs(np.array([got[n] for n in range(90)]) - f).max() < 0.02


def test_members_of_a_bag_choose_their_columns(spark):
    import numpy as np

    from plumbline.operators import models as M

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    rows = spark.createDataFrame([(i, float(x[i, 3] > 0), i % 9, x[i].tolist()) for i in range(200)], "row_id long, y double, grp int, values array<double>")
    assert M.chosen_columns(rows, True, 1) == (3,)
    for backend in (M.Boosting(rounds=20, depth=2, rate=0.3), M.Forest(trees=20)):
        got = {r["row_id"]: r["score"] for r in M.fold_bag(rows, rows, "grp", [1], backend, top=1).collect()}
        assert all((got[i] > 0.5) == (x[i, 3] > 0) for i in range(200) if abs(x[i, 3]) > 0.2)


def test_split_blocks_and_history(spark, tmp_path):
    from plumbline.sources import tables as S

    for s in ("train", "valid"):
        spark.createDataFrame([(1, s)], "row_id long, tag string").write.parquet(str(tmp_path / f"{s}_e.parquet"))
    with pytest.raises(ValueError, match="test_e.parquet"):
        S.split_blocks(spark, str(tmp_path), "e")
    spark.createDataFrame([(1, "test")], "row_id long, tag string").write.parquet(str(tmp_path / "test_e.parquet"))
    assert sorted((r["split"], r["tag"]) for r in S.split_blocks(spark, str(tmp_path), "e").collect()) == [(s, s) for s in ("test", "train", "valid")]
    history = spark.createDataFrame([(2, 0.3), (1, 0.5)], "epoch int, loss double")
    S.write_history(history, {"task": "a", "best_epoch": 2}, str(tmp_path / "run"))
    assert [r["epoch"] for r in spark.read.json(str(tmp_path / "run" / "history")).collect()] == [1, 2]
    assert spark.read.json(str(tmp_path / "run" / "meta")).collect()[0]["best_epoch"] == 2
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_history(history, {}, str(tmp_path / "run"))
