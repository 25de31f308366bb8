import pytest
from pyspark.sql import functions as F

from plumbline.operators import recipes as R
from plumbline.operators.outputs import prediction_rows, write_predictions
from plumbline.sources import tables as S


def test_prediction_files_number_rows_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 7, i % 2, i / 50) for i in range(50)], "row_id long, y int, score double").orderBy(F.rand(1)).repartition(4)
    write_predictions(df, str(tmp_path / "c"), True)
    got = spark.read.option("header", True).schema("sample_idx long, y_true int, y_prob double").csv(str(tmp_path / "c")).orderBy("sample_idx").collect()
    assert [tuple(r) for r in got] == [(i, i % 2, i / 50) for i in range(50)]
    back = prediction_rows(df, False, (10.0, 2.0)).orderBy("sample_idx").collect()
    assert [r["y_pred"] for r in back] == pytest.approx([10 + 2 * i / 50 for i in range(50)]) and back[0].asDict().keys() == {"sample_idx", "y_true", "y_pred"}
    with pytest.raises(Exception, match="(?i)exist"):
        write_predictions(df, str(tmp_path / "c"), True)
    for bad, what in ((df.union(df.limit(1)), "repeats"), (df.withColumn("score", F.lit(float("nan"))), "not finite")):
        with pytest.raises(Exception, match=what):
            prediction_rows(bad, True).collect()


def test_features_are_checked_against_rows_and_inputs(spark, tmp_path):
    inputs = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "row_id long, text string")
    df = spark.createDataFrame([(i, [float(i), None], i % 2) for i in range(9)], "row_id long, values array<double>, y int")
    at = str(tmp_path / "f")
    S.write_features(df, at, ["a", "b"], inputs.repartition(3))
    record = spark.read.json(f"{at}/schema").collect()[0]
    assert (record["rows"], record["width"], record["names"], record["has_y"]) == (9, 2, ["a", "b"], True)
    assert S.check_features(spark, at, inputs).columns == ["row_id", "values", "y"]
    with pytest.raises(ValueError, match="other inputs"):
        S.check_features(spark, at, inputs.limit(8))
    df.limit(1).write.mode("append").parquet(f"{at}/matrix")
    with pytest.raises(ValueError, match="differs"):
        S.check_features(spark, at)
    S.write_features(df.drop("y"), str(tmp_path / "g"), ["a", "b"])
    assert S.check_features(spark, str(tmp_path / "g")).columns == ["row_id", "values"]


def test_blends_know_their_components(spark):
    rows = [(c, None, i, float(i * k)) for k, c in enumerate(("fingerprint_xgb", "metric_head", "expanded_chemical_model", "unused"), 1) for i in range(4)]
    df = spark.createDataFrame(rows, "component string, seed int, row_id long, score double")
    got = {r["row_id"]: r["score"] for r in R.predict(df, "solubility_aqsoldb").collect()}
    assert got == pytest.approx({i: i * (0.3 + 0.6 + 1.2) for i in range(4)})
    with pytest.raises(ValueError, match="missing components"):
        R.predict(df.where("component <> 'metric_head'"), "solubility_aqsoldb")
    with pytest.raises(ValueError, match="takes 3"):
        R.predict(df, "solubility_aqsoldb", names=["a"])
