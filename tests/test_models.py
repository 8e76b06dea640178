import pytest
from pyspark.sql import functions as F

from lathe.operators import knn, models, split, tune


def _clf(spark, n=60):
    rows = [(i, float(i % 10), float((i * 7) % 5), "pos" if i % 10 >= 5 else "neg") for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, y string")


@pytest.mark.parametrize("family", ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "svm"])
def test_classifiers_beat_majority(spark, family):
    df = _clf(spark)
    fm = models.fit_model(df, ["a", "b"], "y", family, "classification", {"n_estimators": 10})
    acc = fm.transform(df).select(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.6


def test_seed_stable(spark):
    df = _clf(spark)
    a = models.fit_model(df, ["a", "b"], "y", "random_forest", "classification", {"n_estimators": 5}).transform(df)
    b = models.fit_model(df, ["a", "b"], "y", "random_forest", "classification", {"n_estimators": 5}).transform(df)
    assert a.select("id", "prediction").collect() == b.select("id", "prediction").collect()


def test_knn_exact_and_blocked(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    pts = rng.normal(size=(80, 3))
    rows = [(i, *map(float, p), "a" if p[0] > 0 else "b") for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, c string")
    train, test = df.where("id < 60"), df.where("id >= 60")
    m = knn.KNNModel.fit(train, ["x", "y", "z"], "c", "classification", 3, id_col="id")
    one = {r["id"]: r["prediction"] for r in m.transform(test).collect()}
    monkeypatch.setattr(knn, "BLOCK_BYTES", 200)  # force several blocks
    many = {r["id"]: r["prediction"] for r in m.transform(test).collect()}
    assert one == many
    # brute force
    tr = pts[:60]
    labels = np.array(["a" if p[0] > 0 else "b" for p in tr])
    for i in range(60, 80):
        d = np.round(np.sqrt(((tr - pts[i]) ** 2).sum(1)), 9)
        nn = np.lexsort((np.arange(60), d))[:3]
        vals, counts = np.unique(labels[nn], return_counts=True)
        assert one[i] == vals[np.argmax(counts)]
    # regression in several blocks equals one block
    reg = knn.KNNModel.fit(train, ["x", "y"], "z", "regression", 3, id_col="id")
    blocked = {r["id"]: r["prediction"] for r in reg.transform(test).collect()}
    monkeypatch.setattr(knn, "BLOCK_BYTES", 256 << 20)
    single = {r["id"]: r["prediction"] for r in reg.transform(test).collect()}
    assert blocked.keys() == single.keys()
    assert all(abs(blocked[k] - single[k]) < 1e-12 for k in single)


def _brute(q, t, k):
    import numpy as np

    with np.errstate(invalid="ignore", over="ignore"):
        d = np.zeros((len(q), len(t)))
        for j in range(t.shape[1]):
            d += (q[:, j, None] - t[None, :, j]) ** 2
        d = np.round(np.sqrt(d), 9)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("kind", ["normal", "integers", "copies", "offset", "scales", "tiny", "odd", "no plain row"])
def test_knn_candidates_are_exact(kind, monkeypatch):
    """Bounded, pruned and measured pairs rank as all pairs do: ties, copies, odd values."""
    import numpy as np

    monkeypatch.setattr(knn, "_ASKED", 16)
    monkeypatch.setattr(knn, "_ROWS", 64)
    rng = np.random.default_rng(3)
    q, t = rng.normal(size=(90, 4)), rng.normal(size=(700, 4))
    if kind == "integers":
        q, t = np.round(q), np.round(t)
    elif kind == "copies":
        t = np.repeat(t[:7], 100, axis=0)[rng.permutation(700)]
        q = t[:90]
    elif kind == "offset":
        q, t = q + 1e9, t + 1e9
    elif kind == "scales":
        q, t = q * [1e-6, 1, 1e3, 1e6], t * [1e-6, 1, 1e3, 1e6]
    elif kind == "tiny":  # distances that rounding makes equal
        q, t = 1 + q * 1e-9, 1 + t * 1e-9
    elif kind in ("odd", "no plain row"):
        q[::7, 1], q[3::20, 2], q[5::30, 0], q[6::30] = np.nan, np.inf, 1e200, 1e120
        t[::5, 0], t[1::9, 2], t[2::50, 3] = np.nan, -np.inf, 1e160
        if kind == "no plain row":
            t[:, 1] = np.inf
    for k in (1, 5, 800):
        (at, d), (want_at, want_d) = knn._topk(q, t, k), _brute(q, t, k)
        assert np.array_equal(at, want_at) and np.array_equal(d, want_d, equal_nan=True)


def test_knn_task_memory_is_bounded():
    """A block of many short rows needs no matrix of all its distances at once."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    q, t = rng.normal(size=(400, 3)), rng.normal(size=(100_000, 3))
    tracemalloc.start()
    knn._topk(q, t, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


@pytest.mark.parametrize("ids", ["one", "missing"])
def test_knn_blocks_do_not_grow_with_an_id(spark, monkeypatch, tmp_path, ids):
    """Rows of one id, or without one, go to blocks like any other, and rank as in one block."""
    import uuid

    import numpy as np

    found, made = knn._topk, str(tmp_path)

    def told(q, t, k):
        with open(f"{made}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(t)))
        return found(q, t, k)

    pts = np.round(np.random.default_rng(5).normal(size=(660, 2)), 1)  # equal distances occur
    rows = [(None if ids == "missing" else 7, *map(float, p), float(i % 5)) for i, p in enumerate(pts)]
    rows = [r if i % 10 else (i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "q long, id long, x double, y double, z double")
    m = knn.KNNModel.fit(df.where("q >= 60"), ["x", "y"], "z", "regression", 4, id_col="id")
    one = {r["q"]: r["_near"] for r in m.neighbours(df.where("q < 60")).collect()}
    monkeypatch.setattr(knn, "_topk", told)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 6_000)  # 75 rows
    many = {r["q"]: r["_near"] for r in m.neighbours(df.where("q < 60")).collect()}
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(sizes) >= 8 and max(sizes) < 150
    assert one == many
    for q, near in one.items():
        d = np.round(np.sqrt(((pts[60:] - pts[q]) ** 2).sum(1)), 9)
        best = sorted(range(600), key=lambda t: (d[t], rows[60 + t][0] is None, rows[60 + t][0] or 0, rows[60 + t][3]))[:4]
        assert near == [rows[60 + t][3] for t in best]


def test_knn_tuning_searches_a_fold_once(spark, monkeypatch):
    """All k of the grid are scored on neighbours that are kept, as are the folds."""
    plans = []
    scored = tune.score_predictions
    monkeypatch.setattr(tune, "score_predictions", lambda pred, *a: (plans.append(pred._jdf.queryExecution().withCachedData().toString()), scored(pred, *a))[1])
    folded = split.kfold_stratified(_clf(spark), "id", "y", 2)
    tune.tune(folded, ["a", "b"], "y", "knn", "classification", "accuracy", {"n_neighbors": [1, 3]})
    assert len(plans) == 4 and all("InMemoryRelation" in p and "CoGroup" not in p.split("InMemoryRelation")[0] for p in plans)
    assert not folded.is_cached


def test_documents_are_joined_without_their_texts(spark, sf):
    from lathe.registry.models import _docs

    plan = _docs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "text#" not in plan.split("Join")[0]


def test_tune_grid_picks_and_refits(spark):
    df = _clf(spark)
    folded = split.kfold_stratified(df, "id", "y", 3)
    model, best, rows = tune.tune(folded, ["a", "b"], "y", "logistic_regression", "classification", "f1",
                                  {"C": [0.01, 1.0]}, parallelism=2)
    assert len(rows) == 2 and sum(r[2] for r in rows) == 1 and "C" in best
    assert tune.sample_grid({"a": [1, 2, 3], "b": [1, 2]}, 3, 42) == tune.sample_grid({"a": [1, 2, 3], "b": [1, 2]}, 3, 42)


def test_model_roundtrip(spark, tmp_path):
    df = _clf(spark)
    fm = models.fit_model(df, ["a", "b"], "y", "decision_tree", "classification")
    fm.save(str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"))
    zero = spark.createDataFrame([(0, 0.0, 0.0, "neg")], df.schema)
    assert fm.transform(zero).first()["prediction"] == loaded.transform(zero).first()["prediction"]
    assert len(models.importances(fm)) == 2


def test_knn_saves_and_reloads(spark, tmp_path):
    df = _clf(spark)
    fm = models.fit_model(df, ["a", "b"], "y", "knn", "classification", {"n_neighbors": 3})
    fm.save(str(tmp_path / "k"))
    loaded = models.load_model(spark, str(tmp_path / "k"))
    pick = lambda m: sorted(map(tuple, m.transform(df).select("id", "prediction", "probabilities").collect()))
    assert pick(fm) == pick(loaded) and loaded.classes == fm.classes


def test_coefficients_keep_their_sign(spark):
    df = spark.createDataFrame([(float(i), -3.0 * i + (i % 2)) for i in range(40)], "x double, y double")
    fm = models.fit_model(df, ["x"], "y", "linear_regression", "regression")
    assert models.importances(fm)[0][1] < -2.9


@pytest.mark.parametrize("family", models.CLASSIFICATION_FAMILIES)
def test_auc_and_rare_class_for_all_families(spark, family):
    """Three classes, one with a single row: every family tunes on AUC and on f1."""
    rows = [(i, float(i % 10), float((i * 7) % 11), 9 if i % 10 < 5 else 10) for i in range(60)] + [(60, 3.0, 4.0, 11)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int").withColumn("fold", F.col("id") % 2)
    small = {"n_estimators": 2} if family in ("random_forest", "gradient_boosting") else {"max_iter": 3} if family == "svm" else {}
    grid = {"n_neighbors": [3, 5]} if family == "knn" else {"C": [1.0]} if family in ("svm", "logistic_regression") else {"max_depth": [2]}
    model, _, rows = tune.tune(df, ["a", "b"], "y", family, "classification", "roc_auc", grid, base_params=small)
    assert model.classes == ["9", "10", "11"] and all(0.5 < r[1] <= 1.0 for r in rows)
    out = model.transform(df).first()
    assert len(out["probabilities"]) == 3 and abs(sum(out["probabilities"]) - 1) < 1e-6
