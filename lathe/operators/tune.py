"""Hyper-parameter search: grid and seeded random search over fold columns.

The search runs MLlib's ``CrossValidator`` with ``foldCol`` (folds from
:func:`lathe.operators.split.kfold` / ``kfold_stratified``), our own evaluator (macro
averages for multi-class, one-vs-rest AUC, negated errors) and ``parallelism`` so the
driver submits the fits of several parameter sets at once. Labels are indexed and features
assembled once, on the whole training part, and kept for all fits, the refit of the best set
included.
"""

from __future__ import annotations

import itertools
import random

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate
from .models import FittedModel, assembled, class_labels, class_scores, fit_model, fitted, label_stats, make_estimator, preparation

# Default grids per family, used when a candidate names none (fixed values).
DEFAULT_GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 150], "max_depth": [5, 10, None]},
    "decision_tree": {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5]},
    "gradient_boosting": {"n_estimators": [50, 100], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "max_iter": [500]},
    "svm": {"C": [0.1, 1.0, 10.0]},
    "knn": {"n_neighbors": [3, 5, 7]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0]},
    "lasso": {"alpha": [0.01, 0.1, 1.0, 10.0]},
}


class MetricEvaluator(Evaluator):
    """Scores a predictions DataFrame (MLlib's ``_label``, ``prediction`` and probability or
    raw prediction columns) with the metrics of :mod:`lathe.operators.evaluate`, all computed
    as aggregations; ``isLargerBetter`` follows the metric."""

    def __init__(self, metric: str, problem_type: str, n_classes: int = 2):
        super().__init__()
        self.metric = evaluate.metric_name(metric)
        self.problem_type = problem_type
        self.n_classes = n_classes

    def _evaluate(self, dataset: DataFrame) -> float:
        if self.problem_type == "regression":
            return score_predictions(dataset, "_label", self.metric, "regression")
        df = dataset.select(F.col("_label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), *class_scores(dataset))
        return score_predictions(df, "label", self.metric, "classification", list(range(self.n_classes)))

    def isLargerBetter(self) -> bool:
        return evaluate.higher_is_better(self.metric)


def expand_grid(grid: dict) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]


def sample_grid(grid: dict, n_iter: int = 10, seed: int = 42) -> list[dict]:
    """Seeded draws without replacement from the full grid (all entries are lists)."""
    allp = expand_grid(grid)
    if n_iter >= len(allp):
        return allp
    return random.Random(seed).sample(allp, n_iter)


def tune(train: DataFrame, features: list[str], target: str, family: str, problem_type: str, metric: str,
         grid: dict, fold_col: str = "fold", base_params: dict | None = None, search: str = "grid",
         n_iter: int = 10, seed: int = 42, parallelism: int = 4):
    """Cross-validated search; returns ``(refitted model, best params, cv table rows)``.

    Each parameter set becomes its own estimator in the param map (parameters such as
    ridge's scaled regularisation depend on the training rows, so they are mapped here).
    A class that a fold's training part lacks keeps its index.
    """
    base = dict(base_params or {})
    sets = expand_grid(grid) if search == "grid" else sample_grid(grid, n_iter, seed)
    if family == "knn":
        return _tune_knn(train, features, target, problem_type, metric, sets, fold_col, base)
    classes = class_labels(train, target) if problem_type == "classification" else None
    n, y_std = label_stats(train, target, problem_type)
    stages = preparation(problem_type, features, target, classes)
    ready = assembled(train, stages).select("_label", "_features", fold_col).persist(StorageLevel.MEMORY_AND_DISK)
    n_folds = ready.agg(F.max(fold_col)).first()[0] + 1
    estimators = [make_estimator(family, problem_type, {**base, **s}, n, y_std, len(classes or [])) for s in sets]
    # one estimator per parameter set, chosen through the stages of a one-stage pipeline
    holder = Pipeline(stages=[estimators[0]])
    maps = ParamGridBuilder().addGrid(holder.stages, [[e] for e in estimators]).build()
    cv = CrossValidator(estimator=holder, estimatorParamMaps=maps,
                        evaluator=MetricEvaluator(metric, problem_type, len(classes or [])), numFolds=n_folds,
                        foldCol=fold_col, parallelism=parallelism, seed=seed)
    cvm = cv.fit(ready)  # refits the best set on all rows
    ready.unpersist()
    scores = list(cvm.avgMetrics)
    best_i = _best(scores, metric)
    model = fitted(family, problem_type, features, target, stages, cvm.bestModel.stages[0], classes)
    return model, {**base, **sets[best_i]}, _rows(sets, scores, best_i)


def _best(scores: list[float], metric: str) -> int:
    """The first of the best scores, as CrossValidator picks it."""
    larger = evaluate.higher_is_better(metric)
    return max(range(len(scores)), key=lambda i: (scores[i] if larger else -scores[i], -i))


def _rows(sets: list[dict], scores: list[float], best: int) -> list[tuple]:
    return [(str(sorted(s.items())), float(sc), i == best) for i, (s, sc) in enumerate(zip(sets, scores))]


def _tune_knn(train, features, target, problem_type, metric, sets, fold_col, base):
    """k-NN is not an MLlib estimator: loop over folds with our model and metrics. The
    neighbours of the largest k are found once for each fold and serve all smaller k; the folds
    are kept while they are searched (unless the caller keeps them)."""
    held = train.storageLevel == StorageLevel.NONE
    if held:
        train.persist(StorageLevel.MEMORY_AND_DISK)
    n_folds = train.agg(F.max(fold_col)).first()[0] + 1
    classes = class_labels(train, target) if problem_type == "classification" else None
    ks = [int({**base, **s}.get("n_neighbors", 5)) for s in sets]
    vals: list[list[float]] = [[] for _ in sets]
    for f in range(n_folds):
        fm = fit_model(train.where(F.col(fold_col) != f), features, target, "knn", problem_type, {"n_neighbors": max(ks)})
        fm.knn.classes = classes
        found = fm.knn.neighbours(train.where(F.col(fold_col) == f)).select(target, "_near").persist(StorageLevel.MEMORY_AND_DISK)
        for i, k in enumerate(ks):
            vals[i].append(score_predictions(fm.knn.vote(found, k), target, metric, problem_type, classes))
        found.unpersist()
    if held:
        train.unpersist()
    scores = [sum(v) / len(v) for v in vals]
    best_i = _best(scores, metric)
    best = {**base, **sets[best_i]}
    return fit_model(train, features, target, "knn", problem_type, best), best, _rows(sets, scores, best_i)


def score_predictions(pred: DataFrame, target: str, metric: str, problem_type: str, classes: list | None = None) -> float:
    """One metric of a predictions table; a metric that it has no columns for is an error."""
    m = evaluate.metric_name(metric)
    if problem_type == "regression":
        return float(evaluate.regression_metrics(pred, target, "prediction").first()[m])
    if m != "roc_auc":
        pos = classes[-1] if classes and len(classes) <= 2 else None
        return evaluate.classification_scores(pred, target, "prediction", pos)[m]
    if "probabilities" not in pred.columns:
        raise evaluate.MetricError("roc_auc needs class probabilities")
    classes = classes or evaluate.class_values(pred, target)
    if len(classes) > 2:
        return float(evaluate.roc_auc_ovr(pred, target, "probabilities", classes).first()["roc_auc"])
    return float(evaluate.roc_auc(pred, target, "score", pos_label=classes[-1]).first()["roc_auc"])


def cv_table(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "params string, mean_score double, best boolean")


__all__ = ["tune", "DEFAULT_GRIDS", "MetricEvaluator", "expand_grid", "sample_grid", "cv_table", "FittedModel"]
