"""A whole run: split, preprocess, engineer, select, then per candidate tune, fit, score,
and pick the best. Every step is one of the library's DataFrame operators; the prepared
training part is persisted once before the candidate loop and released after it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, engineer, evaluate, prep, problem, profile, select, split, tune
from ..operators.models import check_candidates, fit_model, importances
from ..operators.quality import drop_missing_target
from .champion import Champion
from .config import CLASSIFICATION_METRICS, REGRESSION_METRICS, RunConfig, default_config, scale_sensitive


ROWS_PER_PARTITION = 200_000


@dataclass
class CandidateResult:
    candidate_id: str
    position: int
    family: str
    status: str
    params: dict
    metrics: dict = field(default_factory=dict)
    importances: list = field(default_factory=list)
    cv_rows: list = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None
    model: object = None
    predictions: DataFrame | None = None
    train_score: float | None = None  # the primary metric on the training part

    def confusion(self, target: str) -> DataFrame:
        """Confusion matrix of the test predictions."""
        return evaluate.confusion(self.predictions, target, "prediction")

    def class_report(self, target: str) -> DataFrame:
        """Per-class precision, recall, f1 and support of the test predictions."""
        return evaluate.class_report(self.predictions, target, "prediction")


@dataclass
class RunResult:
    problem: problem.Problem
    config: RunConfig
    n_rows: int
    n_train: int
    n_test: int
    features: list[str]
    candidates: list[CandidateResult]
    best_id: str | None
    warnings: list[str]
    seconds: float
    prep_model: prep.PrepModel | None = None
    key: str | None = None

    def champion(self) -> Champion:
        """The best candidate with its preparation, as one artifact that scores raw rows."""
        best = next((c for c in self.candidates if c.candidate_id == self.best_id), None)
        if best is None:
            raise RuntimeError("no candidate was completed")
        return Champion(self.prep_model, self.config.features, best.model, self.key)

    @property
    def status(self) -> str:
        """``completed``, ``incomplete`` (some candidate failed) or ``failed`` (all did)."""
        done = sum(c.status == "completed" for c in self.candidates)
        return "completed" if done == len(self.candidates) else "incomplete" if done else "failed"

    def raise_for_failures(self) -> "RunResult":
        """An error that names the candidates that failed, if any did."""
        if self.status != "completed":
            raise RuntimeError("; ".join(c.error for c in self.candidates if c.error))
        return self


def prep_steps_for(df: DataFrame, prob: problem.Problem, cfg: RunConfig, profile_df=None) -> list:
    """Steps from the recommended column actions (drop, impute, encode, parts, scale)."""
    fams = tuple(c.family for c in cfg.candidates)
    actions = problem.recommend_actions(df, prob.target, fams, profile=profile_df, excluded=prob.excluded)
    plan = problem.column_plan(actions)
    steps = []
    if plan.drop:
        steps.append(prep.Drop(plan.drop, "drop"))
    if plan.impute_median:
        steps.append(prep.Impute(plan.impute_median, "impute_median", "median"))
    if plan.impute_mode:
        steps.append(prep.Impute(plan.impute_mode, "impute_mode", "mode"))
    if plan.one_hot:
        steps.append(prep.OneHot(plan.one_hot, "one_hot"))
    if plan.datetime:
        steps.append(prep.DatetimeParts(plan.datetime, "datetime"))
    do_scale = scale_sensitive(cfg) if cfg.scale is None else cfg.scale
    if do_scale and plan.scale:
        steps.append(prep.Scale(plan.scale, "scale", "standard"))
    return steps


def _split(df, prob, cfg, key):
    s = cfg.split
    if s.strategy == "time":
        return split.split_time(df, s.time_column, key, s.test_size)
    if s.strategy == "stratified":
        if prob.problem_type != "classification":
            raise ValueError("a stratified split needs a classification problem")
        return split.split_stratified(df, key, prob.target, s.test_size, s.seed)
    return split.split_random(df, key, s.test_size, s.seed)


def _numeric_features(df: DataFrame, cols: list[str]) -> list[str]:
    from ..functions.columns import is_numeric_type

    return [c for c in cols if is_numeric_type(df.schema[c].dataType)]


def auto_train(df: DataFrame, target: str | None = None, key: str | None = None, config: RunConfig | None = None,
               problem_type: str = "auto", excluded=(), metric: str | None = None, parallelism: int | None = None,
               tier: str = "standard") -> RunResult:
    t0 = time.time()
    warnings: list[str] = []
    if parallelism is None:  # parameter sets fitted at once by CrossValidator's driver threads
        parallelism = max(2, min(8, df.sparkSession.sparkContext.defaultParallelism))
    prob = problem.resolve_problem(df, target, problem_type, excluded, metric)
    cfg = config or default_config(prob, tier=tier)
    check_candidates(cfg.candidates, prob.problem_type)
    data = drop_missing_target(df, prob.target).drop(*prob.excluded)
    if key is None:
        key = "_row_key"
        data = split.number_rows(data, key)
        warnings.append("no key given: rows are numbered as they were read")
    keep = [c for c in data.columns if c in prob.features or c in (prob.target, key)]
    data = data.select(*keep)
    # the fits of the preparation, the selection and both parts read the split rows
    split_df = _split(data, prob, cfg, key).persist(StorageLevel.MEMORY_AND_DISK)
    train_raw = split_df.where(F.col("split") == "train").drop("split")
    test_raw = split_df.where(F.col("split") == "test").drop("split")

    feats_raw = [c for c in prob.features if c != key and c in data.columns]
    steps = cfg.prep_steps if cfg.prep_steps is not None else prep_steps_for(data.select(*feats_raw, prob.target), prob, cfg)
    pm = prep.PrepPipeline(steps, target=prob.target).fit(train_raw)
    train = pm.transform(train_raw)
    test = pm.transform(test_raw)
    lineage = {}
    for f in pm.fitted:
        for c in f.columns:
            if f.kind == "one_hot":
                values = f.params["categories"][c]
                lineage[c] = [f"{c}_onehot"] if values is None else [f"{c}_{'nan' if v is None else v}" for v in values]
            elif f.kind == "datetime_parts":
                lineage[c] = [f"{c}_{p}" for p in prep.DATETIME_PARTS]
    if cfg.features:
        train, lin = engineer.engineer(train, cfg.features, prob.target, raw_columns=data.columns)
        test, _ = engineer.engineer(test, cfg.features, prob.target, raw_columns=data.columns, check=False)
        for item in lin:
            if item["status"] == "applied":
                for i in item["inputs"]:
                    lineage.setdefault(i, []).append(item["output"])
    # engineered outputs come in through their inputs' lineage
    cands = cfg.selection.candidates or list(prob.features) + [c for f in cfg.features for c in engineer.outputs(f)]
    fallback = [c for c in train.columns if c not in (prob.target, key)]
    selected, _ = select.select_features(
        train.select(*[f.name for f in train.schema.fields if f.name != key and not isinstance(f.dataType, VectorUDT)]), cands, prob.target, cfg.selection.method,
        cfg.selection.threshold, cfg.selection.max_features, prob.problem_type, lineage)
    selected = [c for c in selected if c in fallback]
    # a long category list is one vector, which no selection method scores: it stays whole
    vectors = [c for c in fallback if isinstance(train.schema[c].dataType, VectorUDT)]
    features = _numeric_features(train, selected) + vectors
    if not features:
        raise ValueError("no numeric features remain after preparation")
    cols = [key, prob.target] + features
    staged = train.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    test = test.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    n_train, n_test = staged.count(), test.count()
    split_df.unpersist()
    if n_train < 2 or n_test < 1:
        raise ValueError(f"too few rows to train ({n_train} train, {n_test} test)")
    # Partitions by key hash and sized from the row count alone: what a seeded forest draws does
    # not depend on the cluster, and a small part leaves each concurrent fit one core.
    train = staged.repartition(max(1, math.ceil(n_train / ROWS_PER_PARTITION)), key).persist(StorageLevel.MEMORY_AND_DISK)
    train.count()
    staged.unpersist()

    metrics = CLASSIFICATION_METRICS if prob.problem_type == "classification" else REGRESSION_METRICS
    results = []
    folded = None
    for pos, cand in enumerate(cfg.candidates):
        c0 = time.time()
        try:
            grid, search = (cand.grid, cand.search) if cand.search != "none" else ({}, "none")
            if search == "none" and cfg.default_grids and cand.family in tune.DEFAULT_GRIDS:
                grid, search = tune.DEFAULT_GRIDS[cand.family], "grid"
            if grid:
                if folded is None:
                    folded = (split.kfold_stratified(train, key, prob.target, cfg.folds)
                              if prob.problem_type == "classification" else split.kfold(train, key, cfg.folds))
                    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
                model, params, cv_rows = tune.tune(folded, features, prob.target, cand.family, prob.problem_type,
                                                   cfg.metric, grid, base_params=cand.params, search=search,
                                                   n_iter=cand.n_iter, parallelism=parallelism)
            else:
                model, params, cv_rows = fit_model(train, features, prob.target, cand.family, prob.problem_type,
                                                   cand.params), dict(cand.params), []
            pred = model.transform(test).persist(StorageLevel.MEMORY_AND_DISK)
            vals = score_all(pred, prob, metrics, model.classes)
            pred.unpersist()
            train_score = tune.score_predictions(model.transform(train), prob.target, cfg.metric, prob.problem_type, model.classes)
            results.append(CandidateResult(cand.candidate_id, pos, cand.family, "completed", params, vals,
                                           importances(model) if model.pipeline is not None else [], cv_rows,
                                           time.time() - c0, None, model, pred, train_score))
        except Exception as e:  # noqa: BLE001 - reported as failed; the run's status says so
            results.append(CandidateResult(cand.candidate_id, pos, cand.family, "failed", dict(cand.params),
                                           seconds=time.time() - c0, error=f"{cand.candidate_id}: {e}"))
            warnings.append(f"candidate {cand.candidate_id} failed: {type(e).__name__}")
    if folded is not None:
        folded.unpersist()
    train.unpersist()
    test.unpersist()
    best = best_candidate(results, cfg.metric)
    return RunResult(prob, cfg, n_train + n_test, n_train, n_test, features, results, best, warnings,
                     time.time() - t0, pm, key)


def score_all(pred: DataFrame, prob, metrics, classes: list | None = None) -> dict:
    evaluate.check_predictions(pred, prob.target)
    if prob.problem_type == "regression":
        row = evaluate.regression_metrics(pred, prob.target, "prediction").first()
        return {m: float(row[m]) for m in metrics}
    pos = classes[-1] if classes and len(classes) <= 2 else None
    out = evaluate.classification_scores(pred, prob.target, "prediction", pos)
    return out | {"roc_auc": tune.score_predictions(pred, prob.target, "roc_auc", "classification", classes)}


def best_candidate(results: list[CandidateResult], metric: str) -> str | None:
    """Higher or lower is better by metric name; the first candidate in plan order wins ties."""
    larger = evaluate.higher_is_better(metric)
    name = evaluate.metric_name(metric)
    done = [r for r in results if r.status == "completed" and name in r.metrics]
    if not done:
        return None
    return max(done, key=lambda r: (r.metrics[name] if larger else -r.metrics[name], -r.position)).candidate_id


def metrics_table(spark, result: RunResult) -> DataFrame:
    rows = [(r.candidate_id, r.position, r.family, m, float(v)) for r in result.candidates for m, v in r.metrics.items()]
    return spark.createDataFrame(rows, "model_id string, position int, family string, metric string, value double")


def retrain_compare(df: DataFrame, config_b: RunConfig, target=None, key=None, config_a: RunConfig | None = None,
                    **kw) -> tuple[RunResult, RunResult, DataFrame]:
    """Champion run (``config_a``, default settings) and challenger run (``config_b``) on
    the same data, compared on their primary metric (which must be the same). The rows are
    kept for both runs (unless the caller keeps them)."""
    held = df.storageLevel == StorageLevel.NONE
    if held:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        a = auto_train(df, target, key, config_a, **kw)
        b = auto_train(df, target, key, config_b, **kw)
    finally:
        if held:
            df.unpersist()
    spark = df.sparkSession

    def champ(r: RunResult):
        metric = evaluate.metric_name(r.config.metric)  # each run's own: a mismatch is an error
        best = next((c for c in r.candidates if c.candidate_id == r.best_id), None)
        v = best.metrics.get(metric) if best else None
        return spark.createDataFrame([("data", r.problem.problem_type, r.problem.target, metric, v)],
                                     "dataset_id string, problem_id string, target string, metric string, value double")

    return a, b, compare.compare_runs(champ(a), champ(b))


__all__ = ["auto_train", "retrain_compare", "metrics_table", "best_candidate", "RunResult", "profile"]
