"""Run reports written as data: candidates in plan order, the champion, counts, warnings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate
from .auto import RunResult

_RUN_SCHEMA = ("row_type string, model_id string, position int, family string, status string, metric string, "
               "value double, is_champion boolean, seconds double, detail string")


def run_report(spark: SparkSession, result: RunResult) -> DataFrame:
    """One row per candidate (plan order) with its primary metric, a champion row and a
    summary row (counts, merged sorted warnings)."""
    metric = evaluate.metric_name(result.config.metric)
    rows = []
    for c in result.candidates:
        rows.append(("candidate", c.candidate_id, c.position, c.family, c.status, metric, c.metrics.get(metric),
                     c.candidate_id == result.best_id, float(c.seconds), c.error or json.dumps(c.params, sort_keys=True,
                                                                                                default=str)))
    best = next((c for c in result.candidates if c.candidate_id == result.best_id), None)
    if best is not None:
        rows.append(("champion", best.candidate_id, best.position, best.family, best.status, metric,
                     best.metrics.get(metric), True, float(best.seconds), json.dumps(best.metrics, sort_keys=True)))
    done = sum(1 for c in result.candidates if c.status == "completed")
    summary = {"problem_type": result.problem.problem_type, "target": result.problem.target, "rows": result.n_rows,
               "train_rows": result.n_train, "test_rows": result.n_test, "features": len(result.features),
               "candidates": len(result.candidates), "completed": done, "failed": len(result.candidates) - done,
               "warnings": sorted(set(result.warnings))}
    rows.append(("summary", None, None, None, result.status, metric, None, None,
                 float(result.seconds), json.dumps(summary, sort_keys=True)))
    return spark.createDataFrame(rows, _RUN_SCHEMA)


def executive_report(spark: SparkSession, result: RunResult, comparison: DataFrame | None = None) -> DataFrame:
    """Long table ``section, item, value`` for a summary page: problem, dataset, steps,
    models with the winner flag, governance decision, sorted distinct warnings."""
    metric = evaluate.metric_name(result.config.metric)
    rows = [("problem", "type", result.problem.problem_type), ("problem", "target", result.problem.target),
            ("problem", "metric", metric), ("dataset", "rows", str(result.n_rows)),
            ("dataset", "train_rows", str(result.n_train)), ("dataset", "test_rows", str(result.n_test)),
            ("dataset", "features", str(len(result.features)))]
    if result.prep_model is not None:
        for i, f in enumerate(result.prep_model.fitted):
            rows.append(("steps", f"{i:02d}_{f.kind}", ",".join(f.columns)))
    for c in result.candidates:
        v = c.metrics.get(metric)
        rows.append(("models", c.candidate_id, json.dumps({"family": c.family, "status": c.status, metric: v,
                                                           "winner": c.candidate_id == result.best_id}, sort_keys=True)))
    if comparison is not None:
        for r in comparison.collect():
            rows.append(("governance", "winner", r["winner"]))
            rows.append(("governance", "relative_improvement", str(r["relative_improvement"])))
    for i, w in enumerate(sorted(set(result.warnings))):
        rows.append(("warnings", f"{i:02d}", w))
    return spark.createDataFrame(rows, "section string, item string, value string")
