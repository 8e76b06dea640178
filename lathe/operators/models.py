"""Model families on MLlib, with the reference's (scikit-learn) parameters mapped over.

A fitted model is a ``pyspark.ml.PipelineModel``: label indexing (classification; the labels
of the whole training part in the order of their own type, so a class that a fold lacks keeps
its index), ``VectorAssembler`` over the feature columns, the model, and a converter back to
the label text. Fitting runs MLlib's distributed optimisers; nothing but coefficients, trees
and the list of classes reaches the driver.

Parameter mapping (the objective functions are the same up to scaling):

* ridge(alpha): ``regParam = alpha * stddev_samp(y) / n`` (MLlib scales the label),
  no standardisation, L-BFGS, tight tolerance.
* lasso(alpha): ``elasticNetParam = 1, regParam = alpha``.
* logistic(C) and linear SVM(C): ``regParam = 1 / (C * n)``; logistic stops after
  ``max_iter`` (default 100, as scikit-learn) L-BFGS iterations.
* trees / forests: seed 42, ``max_depth None`` becomes MLlib's limit 30; forest 100 trees.
  ``min_samples_split = s`` maps to ``minInstancesPerNode = max(min_samples_leaf, s // 2)``
  (MLlib bounds the child size, not the parent size: an approximation).
* boosting: 100 iterations, step 0.1, depth 3; multi-class via one-vs-rest.
* SVM is linear only (the reference's default RBF kernel has no distributed form).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import class_values

CLASSIFICATION_FAMILIES = ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "knn", "svm")
REGRESSION_FAMILIES = ("linear_regression", "ridge", "lasso", "decision_tree", "random_forest", "gradient_boosting", "knn")
SEED = 42
MAX_DEPTH = 30
# Speed only (same trees): cache node ids per row instead of re-walking trees each level,
# and let one pass split more nodes.
_TREE_SPEED = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "checkpointInterval": 10}


class ModelError(ValueError):
    pass


@dataclass
class Candidate:
    candidate_id: str
    family: str
    params: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)  # name -> list of values
    search: str = "none"  # none / grid / random
    n_iter: int = 10


def check_candidates(cands: list[Candidate], problem_type: str) -> None:
    ids = [c.candidate_id for c in cands]
    if len(ids) != len(set(ids)):
        raise ModelError("candidate ids must be unique")
    fams = [c.family for c in cands]
    if len(fams) != len(set(fams)):
        raise ModelError("each model family may appear once")
    allowed = CLASSIFICATION_FAMILIES if problem_type == "classification" else REGRESSION_FAMILIES
    bad = [f for f in fams if f not in allowed]
    if bad:
        raise ModelError(f"unsupported model family for {problem_type}: {bad}")


def _depth(v):
    return MAX_DEPTH if v is None else min(int(v), MAX_DEPTH)


def _min_node(p: dict) -> int:
    return max(int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)) // 2, 1)


def label_stats(df: DataFrame, target: str, problem_type: str = "regression") -> tuple[int, float]:
    """Rows with a label, and the label's sample std (regression only)."""
    if problem_type != "regression":
        return df.where(F.col(target).isNotNull()).count(), 1.0
    row = df.agg(F.count(F.col(target)).alias("n"), F.stddev_samp(F.col(target).cast("double")).alias("s")).first()
    return row["n"], row["s"] or 0.0


def make_estimator(family: str, problem_type: str, params: dict, n: int, y_std: float = 1.0, n_classes: int = 2):
    """The MLlib estimator for a family, reading features ``_features`` and label ``_label``."""
    p = dict(params)
    seed = p.pop("random_state", None)
    seed = SEED if seed is None else int(seed)
    common = {"featuresCol": "_features", "labelCol": "_label"}
    cls = problem_type == "classification"
    if family == "linear_regression":
        return LinearRegression(regParam=0.0, solver="auto", **common)
    if family == "ridge":
        alpha = float(p.get("alpha", 1.0))
        return LinearRegression(regParam=alpha * y_std / max(n, 1), elasticNetParam=0.0, standardization=False,
                                solver="l-bfgs", tol=1e-12, maxIter=1000, **common)
    if family == "lasso":
        return LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=1.0, standardization=False,
                                tol=1e-12, maxIter=1000, **common)
    if family == "logistic_regression":
        c = float(p.get("C", 1.0))
        return LogisticRegression(regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                                  tol=float(p.get("tol", 1e-6)), maxIter=int(p.get("max_iter", 100)),
                                  family="multinomial" if n_classes > 2 else "binomial", probabilityCol="probability",
                                  **common)
    if family == "decision_tree":
        kw = {"maxDepth": _depth(p.get("max_depth")), "minInstancesPerNode": _min_node(p),
              "seed": seed, **_TREE_SPEED, **common}
        return DecisionTreeClassifier(**kw) if cls else DecisionTreeRegressor(**kw)
    if family == "random_forest":
        kw = {"numTrees": int(p.get("n_estimators", 100)), "maxDepth": _depth(p.get("max_depth")),
              "minInstancesPerNode": _min_node(p), "seed": seed, **_TREE_SPEED, **common}
        return RandomForestClassifier(**kw) if cls else RandomForestRegressor(**kw)
    if family == "gradient_boosting":
        kw = {"maxIter": int(p.get("n_estimators", 100)), "stepSize": float(p.get("learning_rate", 0.1)),
              "maxDepth": _depth(p.get("max_depth", 3)), "seed": seed}
        if not cls:
            return GBTRegressor(**kw, **common)
        if n_classes > 2:
            return OneVsRest(classifier=GBTClassifier(**kw), parallelism=min(n_classes, 8), **common)
        return GBTClassifier(**kw, **common)
    if family == "svm":
        c = float(p.get("C", 1.0))
        kw = {"regParam": 1.0 / (c * max(n, 1)), "maxIter": int(p.get("max_iter", 100)), "tol": float(p.get("tol", 1e-6))}
        return OneVsRest(classifier=LinearSVC(**kw), parallelism=min(n_classes, 8), **common) if n_classes > 2 else LinearSVC(**kw, **common)
    raise ModelError(f"unsupported model family {family!r}")


@dataclass
class FittedModel:
    family: str
    problem_type: str
    features: list[str]
    target: str
    pipeline: PipelineModel | None = None
    knn: object = None
    classes: list | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Predictions: the input columns plus ``prediction`` (label text for
        classification, double for regression), for classification ``probabilities`` (array
        in class order; one-vs-rest models' raw scores through a logistic, summing to one)
        and ``score`` (of the last class, the positive one of two). They replace columns so
        named."""
        if self.knn is not None:
            return self.knn.transform(df)
        clash = [c for c in ("rawPrediction", "probability", "prediction") if c in df.columns]
        # without the stage that indexes the label: rows to score need none
        out = PipelineModel(self.pipeline.stages[1:]).transform(df.drop(*clash) if clash else df)
        made = ("prediction", "probabilities", "score") if self.problem_type == "classification" else ("prediction",)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in clash and c not in made]
        if self.problem_type == "classification":
            return out.select(*kept, F.col("pred_label").alias("prediction"), *class_scores(out))
        return out.select(*kept, F.col("prediction").cast("double").alias("prediction"))

    @property
    def estimator_model(self):
        return None if self.pipeline is None else self.pipeline.stages[-2 if self.problem_type == "classification" else -1]

    def save(self, path: str) -> None:
        """Write the model with all that :func:`load_model` needs; for nearest neighbours
        that is the training table and the settings."""
        head = {"family": self.family, "problem_type": self.problem_type, "features": self.features, "target": self.target, "classes": self.classes}
        if self.knn is not None:
            head["k"], head["id_col"], spark = self.knn.k, self.knn.id_col, self.knn.train.sparkSession
            self.knn.train.write.mode("overwrite").parquet(f"{path}/train")
        else:
            spark = SparkSession.getActiveSession()
            self.pipeline.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def class_scores(out: DataFrame) -> list:
    """``probabilities`` and ``score`` columns from MLlib's prediction columns."""
    if "probability" in out.columns:
        probs = vector_to_array("probability")
        return [probs.alias("probabilities"), F.element_at(probs, -1).alias("score")]
    raw = vector_to_array("rawPrediction")
    squashed = F.transform(raw, lambda x: 1 / (1 + F.exp(-2 * x)))
    total = F.aggregate(squashed, F.lit(0.0), lambda a, x: a + x)
    return [F.transform(squashed, lambda x: x / total).alias("probabilities"), F.element_at(raw, -1).alias("score")]


def label_indexer(classes: list[str], target: str):
    """Index the target (as text) by its place in ``classes``; other labels are an error."""
    from pyspark.ml.feature import StringIndexerModel

    return StringIndexerModel.from_labels(classes, inputCol=target, outputCol="_label", handleInvalid="error")


def preparation(problem_type: str, features: list[str], target: str, classes: list[str] | None) -> list:
    """The fitted stages before the estimator: ``_label`` and ``_features`` columns."""
    first = label_indexer(classes, target) if problem_type == "classification" else _LabelCopy(target)
    return [first, VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error")]


def _LabelCopy(target):
    from pyspark.ml.feature import SQLTransformer

    return SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS _label FROM __THIS__")


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The classes as text in the order of their own type (a model has a score for each, so
    the list is as bounded as the model)."""
    return class_values(df, target)


def assembled(train: DataFrame, stages: list) -> DataFrame:
    return PipelineModel(stages).transform(train)


def fitted(family, problem_type, features, target, stages, model, classes) -> FittedModel:
    """A fitted estimator with its preparation, as one pipeline model."""
    last = [IndexToString(inputCol="prediction", outputCol="pred_label", labels=classes)] if problem_type == "classification" else []
    return FittedModel(family, problem_type, features, target, PipelineModel([*stages, model, *last]), classes=classes)


def fit_model(train: DataFrame, features: list[str], target: str, family: str, problem_type: str,
              params: dict | None = None) -> FittedModel:
    params = params or {}
    if family == "knn":
        from .knn import KNNModel

        knn = KNNModel.fit(train, features, target, problem_type, int(params.get("n_neighbors", 5)), params.get("id_col"))
        return FittedModel(family, problem_type, features, target, knn=knn, classes=knn.classes)
    classes = class_labels(train, target) if problem_type == "classification" else None
    n, y_std = label_stats(train, target, problem_type)
    stages = preparation(problem_type, features, target, classes)
    estimator = make_estimator(family, problem_type, params, n, y_std, len(classes or []))
    return fitted(family, problem_type, features, target, stages, estimator.fit(assembled(train, stages)), classes)


def load_model(spark: SparkSession, path: str) -> FittedModel:
    """A model written by :meth:`FittedModel.save`."""
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    k, id_col = head.pop("k", None), head.pop("id_col", None)
    if k is None:
        return FittedModel(**head, pipeline=PipelineModel.load(f"{path}/model"))
    from .knn import KNNModel

    train = spark.read.parquet(f"{path}/train")
    return FittedModel(**head, knn=KNNModel(train, head["features"], head["target"], head["problem_type"], k, id_col, head["classes"]))


def importances(fm: FittedModel) -> list[tuple[str, float]]:
    """Tree importances, else coefficients with their sign (multi-class: mean of the absolute
    values over classes; one-vs-rest: mean over the binary models)."""
    m = fm.estimator_model
    if m is None:
        return []
    if hasattr(m, "models"):  # one-vs-rest: mean over the binary models
        parts = [[abs(v) for v in _imp_vector(x)] for x in m.models]
        vals = [sum(v[i] for v in parts) / len(parts) for i in range(len(fm.features))]
    else:
        vals = _imp_vector(m)
    return list(zip(fm.features, [float(v) for v in vals]))


def _imp_vector(m):
    if hasattr(m, "featureImportances"):
        return list(m.featureImportances.toArray())
    if hasattr(m, "coefficientMatrix") and m.coefficientMatrix.numRows > 1:
        arr = m.coefficientMatrix.toArray()
        return [float(abs(arr[:, j]).mean()) for j in range(arr.shape[1])]
    if hasattr(m, "coefficients"):
        return [float(x) for x in m.coefficients.toArray()]
    return []


def forest_importances(df: DataFrame, cols: list[str], target: str, problem_type: str, seed: int = SEED) -> dict:
    """Random forest (100 trees, seed 42) importances for model-based feature selection."""
    fm = fit_model(df, cols, target, "random_forest", problem_type, {"n_estimators": 100, "random_state": seed})
    return dict(importances(fm))


def importance_table(fm: FittedModel, spark) -> DataFrame:
    rows = [(f, i, v) for i, (f, v) in enumerate(importances(fm))]
    return spark.createDataFrame(rows, "feature string, position int, importance double")


def coefficients(fm: FittedModel) -> tuple[list[float], float]:
    m = fm.estimator_model
    return [float(x) for x in m.coefficients.toArray()], float(m.intercept)
