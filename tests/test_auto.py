import random

import pytest

from lathe.operators.problem import resolve_problem
from lathe.plans import auto, report
from lathe.plans.config import default_config
from lathe.sources import io


def test_whole_run_classification(spark):
    rows = [(i, float(i % 7), float(i % 5), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, feat_a double, feat_b double, target int")
    r = auto.auto_train(df, "target", "k", tier="minimal")
    assert r.problem.problem_type == "classification" and r.best_id is not None and r.status == "completed"
    assert all(c.status == "completed" for c in r.candidates)
    rep = report.run_report(spark, r).collect()
    assert sum(1 for x in rep if x["row_type"] == "champion") == 1


def test_whole_run_regression(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random(), rnd.random(), 50 + 10 * rnd.gauss(0, 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, feat_a double, feat_b double, target double")
    # random features are all distinct, so the recommended actions would drop them as ids
    cfg = default_config(resolve_problem(df.drop("k"), "target"), tier="minimal")
    cfg.prep_steps = []
    r = auto.auto_train(df, "target", "k", config=cfg)
    assert r.problem.problem_type == "regression" and r.best_id is not None
    assert set(r.candidates[0].metrics) == {"mae", "mse", "rmse", "r2"}


def test_pipeline_from_csv(spark, tmp_path):
    rows = [(float(i), float(i * 2 % 7), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "feature1 double, feature2 double, target bigint")
    path = str(tmp_path / "data.csv")
    df.coalesce(1).write.option("header", True).csv(path)
    loaded = io.read_table(spark, path, schema="feature1 double, feature2 double, target bigint")
    assert loaded.count() == 100
    r = auto.auto_train(loaded, "target", tier="minimal")
    assert r.n_rows == 100 and r.best_id is not None
    ex = report.executive_report(spark, r).collect()
    assert any(x["section"] == "models" for x in ex)


def test_candidate_checks(spark):
    import pytest

    from lathe.operators.models import Candidate, ModelError

    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "k int, a double, target int")
    cfg = default_config(resolve_problem(df.drop("k"), "target"))
    cfg.candidates = [Candidate("m1", "ridge")]
    with pytest.raises(ModelError):
        auto.auto_train(df, "target", "k", config=cfg)
    cfg.candidates = [Candidate("m1", "svm"), Candidate("m1", "knn")]
    with pytest.raises(ModelError):
        auto.auto_train(df, "target", "k", config=cfg)


def test_default_grids_and_tiers(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "k int, a double, target int")
    prob = resolve_problem(df.drop("k"), "target")
    std, mini = default_config(prob), default_config(prob, tier="minimal")
    assert [c.family for c in std.candidates] == ["logistic_regression", "random_forest", "gradient_boosting"]
    assert len(mini.candidates) == 2 and mini.folds == 3 and std.folds == 5


def test_run_with_engineered_features(spark):
    from lathe.operators.engineer import Interaction, Ratio

    rnd = random.Random(2)
    rows = [(i, rnd.random(), 1 + rnd.random(), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, a double, b double, target int")
    cfg = default_config(resolve_problem(df.drop("k"), "target"), tier="minimal")
    cfg.prep_steps, cfg.default_grids = [], False
    cfg.features = [Interaction("a", "b", "ab"), Ratio("a", "b", "a_over_b")]
    r = auto.auto_train(df, "target", "k", config=cfg).raise_for_failures()
    assert r.features == ["a", "ab", "a_over_b", "b"] and r.status == "completed"
    best = r.candidates[0]
    assert best.train_score is not None and "roc_auc" in best.metrics
    assert best.confusion("target").count() == 4 and best.class_report("target").count() == 5


def test_rows_without_a_key(spark):
    """Equal rows are rows of their own: 10 rows, ten times each, split exactly."""
    rows = [(float(i % 10), float(i % 10) * 2, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    cfg = default_config(resolve_problem(df, "target"), tier="minimal")
    cfg.split.test_size, cfg.prep_steps, cfg.default_grids = 0.25, [], False
    r = auto.auto_train(df, "target", config=cfg).raise_for_failures()
    assert (r.n_train, r.n_test) == (75, 25)


def test_failed_candidate_shows(spark):
    from lathe.operators.models import Candidate

    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "k int, a double, target int")
    cfg = default_config(resolve_problem(df.drop("k"), "target"), tier="minimal")
    cfg.prep_steps, cfg.default_grids = [], False
    cfg.candidates = [Candidate("bad", "svm", {"C": "x"}), Candidate("good", "logistic_regression")]
    r = auto.auto_train(df, "target", "k", config=cfg)
    assert r.status == "incomplete" and r.best_id == "good"
    with pytest.raises(RuntimeError, match="bad"):
        r.raise_for_failures()


def test_retrain_keeps_its_rows_for_both_runs(spark, monkeypatch):
    """Both runs read rows that are kept and let go afterwards; a caller's own stay kept."""
    from types import SimpleNamespace as N

    kept = []
    run = N(config=N(metric="f1"), problem=N(problem_type="classification", target="y"), best_id="m", candidates=[N(candidate_id="m", metrics={"f1": 0.5})])
    monkeypatch.setattr(auto, "auto_train", lambda df, *a, **k: (kept.append(df.is_cached), run)[1])
    df = spark.range(3)
    out = auto.retrain_compare(df, None)[2]
    assert kept == [True, True] and not df.is_cached and out.first()["winner"] == "tie"
    auto.retrain_compare(df.persist(), None)
    assert df.is_cached
    df.unpersist()
