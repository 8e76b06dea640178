import pytest
from pyspark.sql import functions as F

from lathe.operators import compare, evaluate, models


def test_binary_metrics_model(spark):
    train = spark.createDataFrame([(0.0, 0.1, 0), (0.2, 0.0, 0), (0.1, 0.3, 0), (1.0, 0.9, 1), (0.9, 1.1, 1), (1.2, 1.0, 1)],
                                  "A double, B double, y int")
    test = spark.createDataFrame([(0.05, 0.1, 0), (1.1, 1.0, 1)], "A double, B double, y int")
    fm = models.fit_model(train, ["A", "B"], "y", "logistic_regression", "classification")
    pred = fm.transform(test)
    m = evaluate.classification_metrics(pred, "y").first()
    assert m["accuracy"] == 1.0 and m["precision"] == 1.0 and m["recall"] == 1.0 and m["f1"] == 1.0
    assert evaluate.roc_auc(pred, "y", "score").first()["roc_auc"] == 1.0
    cm = evaluate.confusion(pred, "y").collect()
    assert sorted((r["label"], r["prediction"], r["n"]) for r in cm) == [("0", "0", 1), ("0", "1", 0), ("1", "0", 0), ("1", "1", 1)]


def test_multiclass_macro(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "a"), ("c", "c")], "label string, prediction string")
    m = evaluate.classification_metrics(df).first()
    assert m["average"] == "macro"
    assert m["precision"] == pytest.approx((0.5 + 1 + 1) / 3)
    assert m["recall"] == pytest.approx((1 + 1 + 0.5) / 3)
    rep = {r["row"]: r for r in evaluate.class_report(df).collect()}
    assert rep["accuracy"]["precision"] == 0.75 and rep["c"]["support"] == 2


def test_multiclass_model(spark):
    rows = [(float(i), float(i % 3), ["x", "y", "z"][i % 3]) for i in range(6)]
    train = spark.createDataFrame(rows, "A double, B double, y string")
    test = spark.createDataFrame(rows[:3], "A double, B double, y string")
    fm = models.fit_model(train, ["A", "B"], "y", "logistic_regression", "classification")
    pred = fm.transform(test)
    m = evaluate.classification_metrics(pred, "y").first()
    assert m["average"] == "macro" and 0.0 <= m["f1"] <= 1.0
    auc = evaluate.roc_auc_ovr(pred, "y", "probabilities").first()["roc_auc"]
    assert 0.0 <= auc <= 1.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")
    m = evaluate.regression_metrics(df).first()
    assert (m["mae"], m["mse"], m["rmse"]) == (0.5, 0.5, pytest.approx(0.5 ** 0.5))
    assert m["r2"] == pytest.approx(1 - 1.0 / 2.0)


def test_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert evaluate.roc_auc(df).first()["roc_auc"] == pytest.approx(0.875)
    one_class = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert evaluate.roc_auc(one_class).first()["roc_auc"] == 0.0


def test_unknown_metric_raises():
    with pytest.raises(evaluate.MetricError):
        evaluate.metric_name("balanced_thing")
    assert evaluate.metric_name("R_Squared") == "r2"


def test_compare_runs(spark):
    keys = "dataset_id string, problem_id string, target string, metric string, value double"

    def run(metric, value):
        return spark.createDataFrame([("d", "p", "t", metric, value)], keys)

    def res(a, b):
        return compare.compare_runs(a, b).first()

    r = res(run("f1", 0.5), run("f1", 0.6))
    assert r["winner"] == "challenger" and r["relative_improvement"] == pytest.approx(0.2)
    r = res(run("rmse", 2.0), run("rmse", 1.0))
    assert r["winner"] == "challenger" and r["relative_improvement"] == pytest.approx(0.5)
    r = res(run("rmse", 1.0), run("rmse", 1.0 + 1e-12))
    assert r["winner"] == "tie" and not r["improved"]
    r = res(run("r2", 0.0), run("r2", 0.3))
    assert r["relative_improvement"] == 0.0
    with pytest.raises(compare.ComparisonError):
        res(run("f1", 0.5), run("rmse", 0.5))


def test_leaderboard_ties_first_wins(spark):
    m = spark.createDataFrame([("m2", 1, "f1", 0.5), ("m1", 0, "f1", 0.5), ("m3", 2, "f1", 0.4)],
                              "model_id string, position int, metric string, value double")
    assert compare.best_model(m, "f1").first()["model_id"] == "m1"
    board = compare.leaderboard(m, "f1").orderBy("rank").collect()
    assert [r["model_id"] for r in board] == ["m1", "m2", "m3"]


def test_roc_curve_points(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    pts = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df).collect())
    assert pts == [(0.1, 1.0, 1.0), (0.7, 0.5, 1.0), (0.8, 0.5, 0.5), (0.9, 0.0, 0.5)]
