"""Registered queries for models, tuning, whole runs and reports (M, H, X8, X9, S6, S7, G3-G6).

Linear, ridge and lasso fits of one feature have closed forms, and exact k-NN is an SQL
ranking, so those have oracles; iterative fits (logistic, trees, boosting, SVM, tuning,
whole runs) are checked on rows here and on behaviour in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, models, prep, select, split, tune
from ..operators.engineer import Interaction, Ratio, engineer
from ..operators.knn import KNNModel
from ..plans import auto, report
from ..plans.champion import Champion
from ..plans.config import RunConfig, SplitConfig
from ..session import ensure_checkpoint_dir
from ..sources import io
from .evaluation import _REG_LONG, _reg_long
from .profiling import T
from .sqlgen import R


def _coef(family, alpha=None):
    def run(s, sf):
        li = T(s, sf, "lineitem")
        params = {} if alpha is None else {"alpha": alpha}
        fm = models.fit_model(li, ["l_quantity"], "l_extendedprice", family, "regression", params)
        (w,), b = models.coefficients(fm)
        return s.createDataFrame([(family, w, b)], "model string, coefficient double, intercept double").select(
            "model", F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 4).alias("intercept"))
    return run


def _docs(s, sf):
    """Labelled documents with a few numeric features (target ``toxic``, key ``doc_id``)."""
    counted = T(s, sf, "documents").withColumns({  # before the join, which then shuffles no texts
        "n_chars": F.col("n_chars").cast("double"), "n_len": F.length("text").cast("double"),
        "n_words": F.size(F.split("text", " ")).cast("double")}).drop("text")
    return counted.join(T(s, sf, "labels"), "doc_id").select("doc_id", "n_chars", "n_len", "n_words", "lang", "quality", "toxic")


def _prepared(s, sf):
    d = _docs(s, sf)
    sp = split.split_stratified(d, "doc_id", "toxic", 0.2, 42)
    train, test = sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split")
    pm = prep.PrepPipeline([prep.OneHot(["lang"]), prep.Scale(["n_chars", "n_len", "n_words"], method="standard")]).fit(train)
    train, test = pm.transform(train), pm.transform(test)
    feats = [c for c in train.columns if c not in ("doc_id", "toxic")]
    return train, test, feats


def _fit_pred(family, params=None):
    def run(s, sf):
        train, test, feats = _prepared(s, sf)
        fm = models.fit_model(train, feats, "toxic", family, "classification", params or {})
        return fm.transform(test).select("doc_id", "toxic", "prediction")
    return run


def _importance(s, sf):
    train, _, feats = _prepared(s, sf)
    fm = models.fit_model(train, feats, "toxic", "random_forest", "classification", {})
    return models.importance_table(fm, s)


def _importance_linear(s, sf):
    """A falling line keeps its sign."""
    li = T(s, sf, "lineitem").select("l_quantity", (-F.col("l_extendedprice")).alias("falling"))
    fm = models.fit_model(li, ["l_quantity"], "falling", "linear_regression", "regression")
    return models.importance_table(fm, s).select("feature", "position", F.round("importance", 4).alias("importance"))


def _fs_model(s, sf):
    train, _, feats = _prepared(s, sf)
    _, rep = select.select_features(train, feats, "toxic", "model", max_features=3)
    return rep


def _tune(search):
    def run(s, sf):
        train, _, feats = _prepared(s, sf)
        folded = split.kfold_stratified(train, "doc_id", "toxic", 5)
        if search == "grid":
            _, _, rows = tune.tune(folded, feats, "toxic", "logistic_regression", "classification", "f1",
                                   {"C": [0.1, 1.0, 10.0]})
        else:
            _, _, rows = tune.tune(folded, feats, "toxic", "decision_tree", "classification", "f1",
                                   {"max_depth": [2, 3, 4, 5, 8, None], "min_samples_split": [2, 5]}, search="random", n_iter=10)
        return _cv_check(tune.cv_table(s, rows))
    return run


def _cv_check(table):
    """What holds exactly of any search: the number of sets, one best set, and that none beats it."""
    top = F.max(F.when(F.col("best"), F.col("mean_score")))
    return table.agg(F.count_distinct("params").alias("n_sets"), F.count_if("best").alias("n_best"),
                     (top == F.max("mean_score")).alias("best_is_best"), F.count_if(F.col("mean_score").between(0, 1)).alias("n_in_range"))


def _cv_knn(s, sf):
    """k-NN on embeddings, tuned on accuracy over five folds: the table of sets and scores."""
    e = T(s, sf, "embeddings")
    folded = split.kfold_stratified(e, "vec_id", "label", 5)
    _, _, rows = tune.tune(folded, ["embedding"], "label", "knn", "classification", "accuracy", {"n_neighbors": [3, 5, 7]})
    return _cv_check(tune.cv_table(s, rows))


def _roundtrip(s, sf):
    train, test, feats = _prepared(s, sf)
    fm = models.fit_model(train, feats, "toxic", "logistic_regression", "classification")
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/model-{uuid.uuid4().hex}"
    fm.save(path)
    loaded = models.load_model(s, path)
    a = fm.transform(test).select("doc_id", F.col("prediction").alias("p_fit"))
    b = loaded.transform(test).select("doc_id", F.col("prediction").alias("p_loaded"))
    return a.join(b, "doc_id").select("doc_id", (F.col("p_fit") == F.col("p_loaded")).alias("equal"))


def _champion(family):
    """Raw test rows scored by a champion before it is saved and after it is loaded."""
    def run(s, sf):
        d = _docs(s, sf).drop("quality")
        sp = split.split_stratified(d, "doc_id", "toxic", 0.2, 42)
        train, raw = sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split", "toxic")
        steps = [prep.OneHot(["lang"]), prep.Scale(["n_chars", "n_len"], method="standard")]
        pm = prep.PrepPipeline(steps, target="toxic").fit(train)
        made = [Ratio("n_chars", "n_words", "chars_a_word")]
        ready, _ = engineer(pm.transform(train), made)
        feats = [c for c in ready.columns if c not in ("doc_id", "toxic")]
        model = models.fit_model(ready, feats, "toxic", family, "classification", {"id_col": "doc_id"} if family == "knn" else {})
        champion = Champion(pm, made, model, "doc_id")
        path = f"{ensure_checkpoint_dir(s).rstrip('/')}/champion-{uuid.uuid4().hex}"
        champion.write().save(path)
        before, after = (c.transform(raw).select("doc_id", "n_chars", F.struct("prediction", "probabilities", "score").alias(n))
                         for c, n in ((champion, "a"), (Champion.load(path), "b")))
        return before.join(after.drop("n_chars"), "doc_id").select("doc_id", "n_chars", F.col("a").eqNullSafe(F.col("b")).alias("equal"))
    return run


def _predictions(s, sf):
    """What holds exactly of any model's predictions: the keys, the labels' domain, shares."""
    train, test, feats = _prepared(s, sf)
    out = models.fit_model(train, feats, "toxic", "logistic_regression", "classification").transform(test)
    one = F.abs(F.aggregate("probabilities", F.lit(0.0), lambda x, y: x + y) - 1) < 1e-9
    return out.select("doc_id", F.col("prediction").isin("0", "1").alias("in_domain"), one.alias("sums_to_one"),
                      ((F.col("score") > 0.5) == (F.col("prediction") == "1")).alias("agrees"))


def _emb_split(s, sf):
    e = T(s, sf, "embeddings")
    sp = split.split_random(e, "vec_id", 0.2, 42)
    return sp.where("split = 'train'").drop("split"), sp.where("split = 'test'").drop("split")


def _knn(problem_type):
    def run(s, sf):
        train, test = _emb_split(s, sf)
        if problem_type == "regression":
            train = train.withColumn("label", F.col("label").cast("double"))
        m = KNNModel.fit(train, ["embedding"], "label", problem_type, 5, id_col="vec_id")
        out = m.transform(test.select("vec_id", "embedding")).select("vec_id", "prediction")
        return out if problem_type == "classification" else out.select("vec_id", F.round("prediction", 6).alias("prediction"))
    return run


def _auto(s, sf):
    r = auto.auto_train(_docs(s, sf), "toxic", "doc_id", tier="minimal")
    return report.run_report(s, r)


def _auto_counts(s, sf):
    """What holds exactly of a whole run: rows of its parts, candidates, status."""
    r = auto.auto_train(_docs(s, sf), "toxic", "doc_id", tier="minimal")
    return s.createDataFrame([(r.n_rows, r.n_train, r.n_test, len(r.candidates), r.status)],
                             "n_rows long, n_train long, n_test long, candidates int, status string")


def _auto_features(s, sf):
    """A run with engineered features: each feature once, no candidate fails."""
    d = _docs(s, sf).select("doc_id", "n_chars", "n_words", "toxic")
    cfg = RunConfig(split=SplitConfig("stratified"), metric="roc_auc", prep_steps=[], default_grids=False,
                    features=[Interaction("n_chars", "n_words", "product"), Ratio("n_chars", "n_words", "chars_a_word")],
                    candidates=[models.Candidate("model_001", "logistic_regression"), models.Candidate("model_002", "decision_tree")])
    r = auto.auto_train(d, "toxic", "doc_id", config=cfg).raise_for_failures()
    return s.createDataFrame([(r.n_rows, r.n_train, r.n_test, ",".join(sorted(r.features)), ",".join(c.candidate_id for c in r.candidates), r.status)],
                             "n_rows long, n_train long, n_test long, features string, candidates string, status string")


def _retrain(s, sf):
    d = _docs(s, sf)
    prob_cfg = RunConfig(split=SplitConfig("stratified"), metric="f1",
                         candidates=[models.Candidate("model_001", "decision_tree", {"max_depth": 5})])
    _, _, cmp = auto.retrain_compare(d, prob_cfg, "toxic", "doc_id", tier="minimal")
    return cmp


def _exec(s, sf):
    r = auto.auto_train(_docs(s, sf), "toxic", "doc_id", tier="minimal")
    return report.executive_report(s, r)


def _report_json(s, sf):
    board = compare.leaderboard(_reg_long(s, sf), "rmse")
    path = f"{ensure_checkpoint_dir(s).rstrip('/')}/report-{uuid.uuid4().hex}"
    io.write_report(board, path)
    return io.read_report(s, path, board.schema)


QUERIES = {
    "linreg_fit": _coef("linear_regression"),
    "ridge_fit": _coef("ridge", 1000.0),
    "lasso_fit": _coef("lasso", 100.0),
    "logreg_fit": _fit_pred("logistic_regression"),
    "tree_fit": _fit_pred("decision_tree"),
    "forest_fit": _fit_pred("random_forest"),
    "gbt_fit": _fit_pred("gradient_boosting"),
    "svm_fit": _fit_pred("svm"),
    "knn_classify": _knn("classification"),
    "knn_regress": _knn("regression"),
    "fs_model_based": _fs_model,
    "feature_importance": _importance,
    "feature_importance_linear": _importance_linear,
    "predictions": _predictions,
    "model_roundtrip": _roundtrip,
    "champion_roundtrip": _champion("logistic_regression"),
    "champion_roundtrip_knn": _champion("knn"),
    "tune_grid": _tune("grid"),
    "tune_random": _tune("random"),
    "cv_results": _cv_knn,
    "auto_train": _auto_counts,
    "auto_train_features": _auto_features,
    "retrain_compare": _retrain,
    "run_report": _auto,
    "executive_report": _exec,
    "report_json": _report_json,
}

# ------------------------------------------------------------------------------ oracles

_X, _Y = "l_quantity", "l_extendedprice"


def _lin_sql(model, slope):
    return (f"WITH s AS (SELECT {slope} AS w, avg({_Y}) AS my, avg({_X}) AS mx FROM lineitem) "
            f"SELECT '{model}' AS model, {R('w', 4)} AS coefficient, {R('my - w * mx', 4)} AS intercept FROM s")


_SPLIT_EMB = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) - 1 AS rn FROM embeddings),
sp AS (SELECT *, rn < ceil(0.2 * (SELECT count(*) FROM embeddings)) AS is_test FROM r),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label,
             round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 9) AS dist
      FROM sp q JOIN sp t ON q.is_test AND NOT t.is_test),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rk FROM d) WHERE rk <= 5)
"""

_LABELLED = "(SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id))"
_N = f"(SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM {_LABELLED})"
_TESTED = f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1 AS rn,
                  count(*) OVER (PARTITION BY toxic) AS nc FROM {_LABELLED}),
n AS (SELECT * FROM {_N}),
c AS (SELECT DISTINCT toxic, nc, (nc * t) // n AS base, (nc * t) % n AS rem FROM d, n),
o AS (SELECT *, row_number() OVER (ORDER BY rem DESC, toxic) AS place, sum(base) OVER () AS given FROM c),
quota AS (SELECT toxic, base + CASE WHEN place <= (SELECT t FROM n) - given THEN 1 ELSE 0 END AS take FROM o),
test AS (SELECT doc_id FROM d JOIN quota USING (toxic) WHERE rn < take)
"""

ORACLES = {
    "feature_importance_linear": f"SELECT 'l_quantity' AS feature, 0 AS position, {R('regr_slope(-l_extendedprice, l_quantity)', 4)} AS importance FROM lineitem",
    "predictions": _TESTED + "SELECT doc_id, TRUE AS in_domain, TRUE AS sums_to_one, TRUE AS agrees FROM test",
    **{n: _TESTED + "SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, TRUE AS equal FROM test JOIN documents USING (doc_id)" for n in ("champion_roundtrip", "champion_roundtrip_knn")},
    "model_roundtrip": _TESTED + "SELECT doc_id, TRUE AS equal FROM test",
    "tune_grid": f"SELECT 3 AS n_sets, 1 AS n_best, n > 0 AS best_is_best, 3 AS n_in_range FROM {_N}",
    "tune_random": f"SELECT 10 AS n_sets, 1 AS n_best, n > 0 AS best_is_best, 10 AS n_in_range FROM {_N}",
    "cv_results": "SELECT 3 AS n_sets, 1 AS n_best, count(*) > 0 AS best_is_best, 3 AS n_in_range FROM embeddings",
    "auto_train": f"SELECT n AS n_rows, n - t AS n_train, t AS n_test, 2 AS candidates, 'completed' AS status FROM {_N}",
    "auto_train_features": f"SELECT n AS n_rows, n - t AS n_train, t AS n_test, 'chars_a_word,n_chars,n_words,product' AS features, "
    f"'model_001,model_002' AS candidates, 'completed' AS status FROM {_N}",
    "linreg_fit": _lin_sql("linear_regression", f"regr_slope({_Y}, {_X})"),
    "ridge_fit": _lin_sql("ridge", f"covar_pop({_X}, {_Y}) / (var_pop({_X}) + 1000.0 / count(*))"),
    "lasso_fit": _lin_sql("lasso", f"sign(covar_pop({_X}, {_Y})) * greatest(abs(covar_pop({_X}, {_Y})) - 100.0, 0) / var_pop({_X})"),
    "knn_classify": _SPLIT_EMB + """
, votes AS (SELECT qid, CAST(label AS VARCHAR) AS lab, count(*) AS n FROM top GROUP BY ALL)
SELECT qid AS vec_id, arg_min(lab, (-n, lab)) AS prediction FROM votes GROUP BY qid""",
    "knn_regress": _SPLIT_EMB + f"SELECT qid AS vec_id, {R('avg(label)', 6)} AS prediction FROM top GROUP BY qid",
    "report_json": "WITH " + _REG_LONG
    + f", r AS (SELECT model_id, position, metric, {R('value', 4)} AS value FROM long WHERE metric = 'rmse') "
    "SELECT *, CAST(row_number() OVER (ORDER BY value, position) AS INTEGER) AS rank FROM r",
}
