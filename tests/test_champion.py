"""A champion scores raw rows alike before it is saved and after it is loaded."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lathe.operators import engineer, models, prep
from lathe.plans import auto
from lathe.plans.champion import Champion
from lathe.plans.config import RunConfig, SplitConfig


def raw(spark, n=120):
    i = F.col("id")
    return spark.range(n).select(
        i, F.when(i % 9 != 0, (i % 17).cast("double")).alias("a"), (i % 5 + 1).cast("double").alias("b"), F.concat(F.lit("c"), i % 4).alias("kind"),
        F.timestamp_seconds(i * 90_000).alias("at"), (i % 3).cast("int").alias("score"), F.when(i % 17 < 8, "lo").otherwise("hi").alias("y"))


def scored(model, rows):
    return sorted(map(str, model.transform(rows).collect()))


def champion(spark, family, problem_type="classification", output="auto"):
    table = raw(spark)
    steps = [prep.Impute(["a"], "s1", "median"), prep.OneHot(["kind"], "s2", output), prep.Scale(["b"], "s3"), prep.DatetimeParts(["at"], "s4")]
    target = "y" if problem_type == "classification" else "a2"
    table = table.withColumn("a2", F.col("id") * 2.0)
    pm = prep.PrepPipeline(steps, target=target).fit(table)
    made = [engineer.Difference("a", "b", "ab"), engineer.Log1p("a", "la")]
    ready, _ = engineer.engineer(pm.transform(table), made)
    feats = [c for c in ready.columns if c not in ("id", "y", "a2")]
    params = {"id_col": "id"} if family == "knn" else {"n_estimators": 3} if "forest" in family or "boost" in family else {}
    return Champion(pm, made, models.fit_model(ready, feats, target, family, problem_type, params), "id")


@pytest.mark.parametrize(("family", "output"), [("logistic_regression", "auto"), ("decision_tree", "vector"), ("random_forest", "auto"), ("knn", "auto"), ("knn", "vector"), ("svm", "vector")])
def test_raw_rows_before_and_after(spark, tmp_path, family, output):
    own = champion(spark, family, output=output)
    own.write().overwrite().save(str(tmp_path / "c"))
    again = Champion.load(str(tmp_path / "c"))
    assert again.uid == own.uid and again.key == "id" and again.model.classes == ["hi", "lo"]
    rows = raw(spark).drop("y")  # no target, and a user's column named score
    assert scored(own, rows) == scored(again, rows)
    out = again.transform(rows)
    assert out.columns == ["id", "a", "b", "kind", "at", "prediction", "probabilities", "score"] and out.count() == rows.count()
    assert sorted(map(str, out.select("id", "a", "b", "kind", "at").collect())) == sorted(map(str, rows.select("id", "a", "b", "kind", "at").collect()))
    assert scored(again, raw(spark).withColumn("y", F.lit(None).cast("string"))) == scored(again, raw(spark).withColumn("y", F.lit("?")).withColumn("y", F.lit(None).cast("string")))


def test_regression_and_pipeline_stage(spark, tmp_path):
    own = champion(spark, "linear_regression", "regression")
    PipelineModel([own]).write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    rows = raw(spark, 40)
    assert scored(own, rows) == scored(again, rows)
    assert "prediction" in again.transform(rows).columns


def test_knn_ties_after_reload(spark, tmp_path):
    """Ten equally near rows: the smaller ids vote, before and after."""
    train = spark.createDataFrame([(9 - i, 1.0, f"c{i}") for i in range(10)], "id int, x double, y string")
    model = models.fit_model(train, ["x"], "y", "knn", "classification", {"n_neighbors": 1, "id_col": "id"})
    model.save(str(tmp_path / "k"))
    query = spark.createDataFrame([(0, 1.0)], "id int, x double")
    assert [m.transform(query).first()["prediction"] for m in (model, models.load_model(spark, str(tmp_path / "k")))] == ["c9", "c9"]


def test_champion_of_a_run(spark, tmp_path, monkeypatch):
    """From raw rows to the saved champion, with a column of many categories."""
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 3)
    cfg = RunConfig(split=SplitConfig("stratified"), metric="f1", default_grids=False, prep_steps=[prep.Impute(["a"], "s1", "median"), prep.OneHot(["kind"], "s2")],
                    features=[engineer.DatetimeParts("at", "t"), engineer.Interaction("a", "b", "ab")],
                    candidates=[models.Candidate("m1", "logistic_regression"), models.Candidate("m2", "decision_tree")])
    run = auto.auto_train(raw(spark).drop("score"), "y", "id", config=cfg).raise_for_failures()
    assert "kind_onehot" in run.features and {"t_hour", "ab"} <= set(run.features)
    own = run.champion()
    own.write().save(str(tmp_path / "c"))
    rows = raw(spark, 300).drop("y", "score")
    assert scored(own, rows) == scored(Champion.load(str(tmp_path / "c")), rows)
    assert own.transform(rows).count() == 300
