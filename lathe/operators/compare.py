"""Model comparison: leaderboard / best candidate, and champion versus challenger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import HIGHER_IS_BETTER, LOWER_IS_BETTER, metric_name

TIE_TOLERANCE = 1e-9  # fixed value: a smaller difference is a tie


class ComparisonError(ValueError):
    pass


def _signed(metric_col="metric", value_col="value"):
    """The value oriented so that larger is better."""
    return F.when(F.col(metric_col).isin(*HIGHER_IS_BETTER), F.col(value_col)).otherwise(-F.col(value_col))


def leaderboard(metrics: DataFrame, metric: str, model="model_id", position="position") -> DataFrame:
    """Candidates ranked on ``metric`` (higher or lower is better by name); ties go to the
    earlier candidate in plan order. Input: long ``model_id, position, metric, value``.
    Output: ``model_id, position, metric, value, rank``."""
    name = metric_name(metric)
    m = metrics.where(F.col("metric") == name)
    w = Window.partitionBy("metric").orderBy(_signed().desc(), F.col(position).asc())
    return m.select(model, position, "metric", "value", F.row_number().over(w).alias("rank"))


def best_model(metrics: DataFrame, metric: str, model="model_id", position="position") -> DataFrame:
    """The winning row of :func:`leaderboard` (a ``min_by`` over the ranking key)."""
    name = metric_name(metric)
    m = metrics.where(F.col("metric") == name)
    key = F.struct((-_signed()).alias("k"), F.col(position).alias("p"))
    return m.groupBy("metric").agg(
        F.min_by(model, key).alias(model), F.min_by(position, key).alias(position), F.min_by("value", key).alias("value"))


def compare_runs(champion: DataFrame, challenger: DataFrame, keys=("dataset_id", "problem_id", "target")) -> DataFrame:
    """Champion versus challenger, each a table ``*keys, metric, value`` (one row per run).

    Output per key: ``metric, champion_value, challenger_value, difference, winner
    (tie/champion/challenger), improved, relative_improvement``. A difference below 1e-9
    is a tie (the champion stays); relative improvement is ``(new-old)/old`` (sign flipped
    for lower-is-better metrics) and 0 when the champion's value is 0. Keys and metric
    must match: rows of one run without a partner are an error.
    """
    keys = list(keys)
    a = champion.select(*keys, F.lower("metric").alias("metric"), F.col("value").alias("champion_value"))
    b = challenger.select(*keys, F.lower("metric").alias("metric_b"), F.col("value").alias("challenger_value"))
    j = a.join(b, keys, "full")
    unknown = ~F.col("metric").isin(*(HIGHER_IS_BETTER + LOWER_IS_BETTER))
    bad = j.where(F.col("metric").isNull() | F.col("metric_b").isNull() | (F.col("metric") != F.col("metric_b")) | unknown)
    if not bad.isEmpty():
        raise ComparisonError("runs differ in dataset, problem, target or metric, or the metric is not comparable")
    diff = F.col("challenger_value") - F.col("champion_value")
    higher = F.col("metric").isin(*HIGHER_IS_BETTER)
    better = F.when(higher, diff > 0).otherwise(diff < 0)
    tie = F.abs(diff) < TIE_TOLERANCE
    rel = F.when(F.col("champion_value") == 0, F.lit(0.0)).otherwise(
        F.when(higher, diff).otherwise(-diff) / F.col("champion_value"))
    return j.select(
        *keys, "metric", "champion_value", "challenger_value", diff.alias("difference"),
        F.when(tie, "tie").when(better, "challenger").otherwise("champion").alias("winner"),
        (~tie & better).alias("improved"), rel.alias("relative_improvement"),
    )
