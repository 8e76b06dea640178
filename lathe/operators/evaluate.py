"""Metrics as distributed aggregations over a predictions table.

A predictions table has a label column, a prediction column, optionally a score
(probability of the positive class) and optionally a model id column; every metric is
computed per model id in one pass. Counts per ``(label, prediction)`` are the only
intermediate: a handful of rows per model whatever the size of the test part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import running_sums

# Fixed values (metric directions and aliases must equal the reference's).
HIGHER_IS_BETTER = ("accuracy", "precision", "recall", "f1", "roc_auc", "r2")
LOWER_IS_BETTER = ("mae", "mse", "rmse")
ALIASES = {
    "accuracy": "accuracy", "f1": "f1", "precision": "precision", "recall": "recall", "roc_auc": "roc_auc",
    "auc": "roc_auc", "mae": "mae", "mean_absolute_error": "mae", "mse": "mse", "mean_squared_error": "mse",
    "rmse": "rmse", "root_mean_squared_error": "rmse", "r2": "r2", "r_squared": "r2",
}


class MetricError(ValueError):
    pass


def metric_name(name: str) -> str:
    """Canonical metric name; an unknown name is an error (never a silent 0.0)."""
    key = ALIASES.get(name.strip().lower())
    if key is None:
        raise MetricError(f"unknown metric {name!r}")
    return key


def higher_is_better(name: str) -> bool:
    return metric_name(name) in HIGHER_IS_BETTER


def _mid(model: str | None) -> list[Column]:
    return [F.col(model)] if model else [F.lit("model").alias("_model")]


def _mcol(model):
    return model or "_model"


def check_predictions(df: DataFrame, label="label") -> None:
    """An empty predictions table or a missing label is an error (one small aggregation)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(label)).alias("k")).first()
    if row["n"] == 0:
        raise MetricError("the predictions table is empty")
    if row["k"] != row["n"]:
        raise MetricError(f"{row['n'] - row['k']} rows have no label")


def pair_counts(df: DataFrame, label="label", prediction="prediction", model: str | None = None) -> DataFrame:
    """``model, label, prediction, n``: rows per (label, prediction), labels as text."""
    return df.groupBy(*_mid(model), F.col(label).cast("string").alias("label"),
                      F.col(prediction).cast("string").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label="label", prediction="prediction", model: str | None = None) -> DataFrame:
    """Confusion matrix over the union of labels and predictions, zero cells included:
    ``model, label, prediction, n``. The class table is paired with itself per model, so the
    matrix (the result) is built by tasks, not on the driver."""
    counts = pair_counts(df, label, prediction, model)
    m = _mcol(model)
    classes = counts.select(m, F.explode(F.array("label", "prediction")).alias("label")).distinct()
    grid = classes.join(classes.withColumnRenamed("label", "prediction"), m)
    both = [grid[m].eqNullSafe(counts[m]), grid["label"].eqNullSafe(counts["label"]), grid["prediction"].eqNullSafe(counts["prediction"])]
    return grid.join(counts, both, "left").select(
        grid[m], grid["label"], grid["prediction"], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(df: DataFrame, label="label", prediction="prediction", model: str | None = None) -> DataFrame:
    """``model, class, tp, n_pred, n_true, precision, recall, f1`` (zero division -> 0).

    Each (label, prediction) count goes to its label's and its prediction's class: two
    aggregations of partial sums, no join."""
    counts = pair_counts(df, label, prediction, model)
    m = _mcol(model)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), zero.alias("n_pred"), F.col("n").alias("n_true")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), F.col("n").alias("n_pred"), zero.alias("n_true")),
    )
    out = counts.select(m, F.inline(sides)).groupBy(m, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_true")), F.lit(0.0))
    out = out.withColumn("precision", prec.cast("double")).withColumn("recall", rec.cast("double"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def label_order(df: DataFrame, label: str, text: Column) -> Column:
    """The order of a label given as text: that of the label column's own type (9 before 10)."""
    kind = df.schema[label].dataType
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def classification_metrics(df: DataFrame, label="label", prediction="prediction", model: str | None = None,
                           pos_label: str | None = None) -> DataFrame:
    """``model, accuracy, precision, recall, f1, average``: binary for the positive label
    (default: the largest label, in the label's own type) when the true labels have at most
    two values, else macro averages over the union of labels."""
    pc = per_class(df, label, prediction, model)
    m = _mcol(model)
    true = F.col("n_true") > 0
    if pos_label is None:
        at = F.when(true, label_order(df, label, F.col("class")))
        binary = [F.max_by(c, at).alias(f"b_{c}") for c in ("precision", "recall", "f1")]
    else:
        binary = [F.max(F.when(F.col("class") == F.lit(str(pos_label)), F.col(c))).alias(f"b_{c}") for c in ("precision", "recall", "f1")]
    agg = pc.groupBy(m).agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"), F.count_if(true).alias("n_labels"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *binary)
    multi = F.col("n_labels") > 2
    return agg.select(
        m, "accuracy",
        *[F.when(multi, F.col(f"m_{c}")).otherwise(F.coalesce(f"b_{c}", F.lit(0.0))).alias(c) for c in ("precision", "recall", "f1")],
        F.when(multi, F.lit("macro")).otherwise(F.lit("binary")).alias("average"),
    )


def classification_scores(df: DataFrame, label="label", prediction="prediction", pos_label=None) -> dict:
    """:func:`classification_metrics` for one model as a dict; one row reaches the driver."""
    row = classification_metrics(df, label, prediction, pos_label=pos_label).first()
    return {k: float(row[k]) for k in ("accuracy", "precision", "recall", "f1")} if row else dict.fromkeys(("accuracy", "precision", "recall", "f1"), 0.0)


def class_report(df: DataFrame, label="label", prediction="prediction", model: str | None = None) -> DataFrame:
    """Per class precision, recall, f1, support, then rows ``accuracy``, ``macro avg`` and
    ``weighted avg``: ``model, row, precision, recall, f1, support``."""
    pc = per_class(df, label, prediction, model)
    m = _mcol(model)
    rows = pc.select(m, F.col("class").alias("row"), "precision", "recall", "f1", F.col("n_true").alias("support"))
    tot = pc.groupBy(m).agg(
        (F.sum("tp") / F.sum("n_true")).alias("acc"), F.sum("n_true").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("n_true")) / F.sum("n_true")).alias("wp"),
        (F.sum(F.col("recall") * F.col("n_true")) / F.sum("n_true")).alias("wr"),
        (F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("wf"),
    )
    acc = tot.select(m, F.lit("accuracy").alias("row"), "acc", "acc", "acc", "n").toDF(*rows.columns)
    mac = tot.select(m, F.lit("macro avg"), "mp", "mr", "mf", "n").toDF(*rows.columns)
    wei = tot.select(m, F.lit("weighted avg"), "wp", "wr", "wf", "n").toDF(*rows.columns)
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def auc_by_group(df: DataFrame, group: Column, positive: Column, score: Column) -> DataFrame:
    """Tie-aware ROC AUC per group: ``g, auc`` (NULL when a group lacks either class).

    Rows are first grouped by ``(g, score)`` into positive and negative counts, so a
    score shared by a third of the rows is one row. Negatives below each score are a
    running sum over range partitions of (group, score), so a window task holds a partition
    whatever the groups' sizes.
    """
    by_score = df.groupBy(group.alias("g"), score.cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ranked = running_sums(by_score, "g", "score", {"neg": "below"}, -1)
    return ranked.groupBy("g").agg(
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
         / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
    ).select("g", F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("auc")).alias("auc"))


def _positive(df: DataFrame, label: str, pos_label) -> str | None:
    """The positive label as text; default: the largest in the label's own type."""
    return str(pos_label) if pos_label is not None else df.agg(F.max(label).cast("string")).first()[0]


def roc_curve(df: DataFrame, label="label", score="score", pos_label=None) -> DataFrame:
    """ROC curve points ``threshold, fpr, tpr`` (one per distinct score, highest first),
    from the same per-score counts as :func:`roc_auc`; cumulative counts from the top are
    running sums over range partitions, never a global window."""
    pos = F.col(label).cast("string") == F.lit(_positive(df, label, pos_label))
    by_score = df.groupBy(F.lit(0).alias("g"), (-F.col(score).cast("double")).alias("score")).agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    cum = running_sums(by_score, "g", "score", {"neg": "fp", "pos": "tp"}, 0)
    total = df.agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")).first()
    return cum.select((-F.col("score")).alias("threshold"), (F.col("fp") / F.lit(float(total["n"]) or float("nan"))).alias("fpr"),
                      (F.col("tp") / F.lit(float(total["p"]) or float("nan"))).alias("tpr"))


def roc_auc(df: DataFrame, label="label", score="score", model: str | None = None, pos_label=None) -> DataFrame:
    """Binary ROC AUC per model (``model, roc_auc``); positive label default: the
    largest label. Undefined (one class only) gives 0.0 as the reference does."""
    m = _mcol(model)
    lab = F.col(label).cast("string")
    res = auc_by_group(df.select(*_mid(model), lab.alias("_l"), F.col(score).alias("_s")), F.col(m),
                       F.col("_l") == F.lit(_positive(df, label, pos_label)), F.col("_s"))
    return res.select(F.col("g").alias(m), F.coalesce("auc", F.lit(0.0)).alias("roc_auc"))


def class_values(df: DataFrame, label: str) -> list[str]:
    """The labels as text, in the order of their own type (missing ones left out)."""
    rows = df.select(F.col(label).alias("c")).where(F.col("c").isNotNull()).distinct().select("c", F.col("c").cast("string").alias("t")).collect()
    return [r["t"] for r in sorted(rows, key=lambda r: r["c"])]


def roc_auc_ovr(df: DataFrame, label="label", probs="probabilities", classes: list | None = None,
                model: str | None = None) -> DataFrame:
    """Macro one-vs-rest AUC: ``probs`` is an array column of class probabilities in the
    order of ``classes`` (sorted labels). ``model, roc_auc``."""
    m = _mcol(model)
    if classes is None:
        classes = [str(c) for c in class_values(df, label)]  # one per probability column
    cls = F.array(*[F.lit(str(c)) for c in classes])
    long = df.select(*_mid(model), F.col(label).cast("string").alias("_l"),
                     F.posexplode(F.arrays_zip(cls.alias("c"), F.col(probs).alias("p"))).alias("i", "z"))
    long = long.select(m, "_l", F.col("z.c").alias("_c"), F.col("z.p").alias("_p"))
    res = auc_by_group(long, F.struct(F.col(m).alias("m"), F.col("_c").alias("c")), F.col("_l") == F.col("_c"), F.col("_p"))
    return res.groupBy(F.col("g.m").alias(m)).agg(F.coalesce(F.avg("auc"), F.lit(0.0)).alias("roc_auc"))


def regression_metrics(df: DataFrame, label="label", prediction="prediction", model: str | None = None) -> DataFrame:
    """``model, mae, mse, rmse, r2`` in one aggregation (SST = n * var_pop(label))."""
    m = _mcol(model)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    agg = df.groupBy(*_mid(model)).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"),
        F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    r2 = (F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(m, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def metrics_long(wide: DataFrame, ids: list[str] | str, names: list[str]) -> DataFrame:
    """``*ids, metric, value`` from a wide metrics table."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    stack = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return wide.selectExpr(*ids, f"stack({len(names)}, {stack}) as (metric, value)")
