"""Problem setup: target, problem type, features, metric, and recommended column actions.

These are rules over the column profile, written as ``when`` chains on the profile
DataFrame so that every column is classified in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import column_profile

CLASSIFICATION = "classification"
REGRESSION = "regression"

# Fixed values of the rules (they must equal the reference's for equal results).
ID_NAMES = ("id", "uuid", "guid", "ticket", "name")
ID_SUFFIX = "id"
MAX_CLASS_DISTINCT = 20  # numeric target with at most this many distinct values ...
MAX_CLASS_DISTINCT_PCT = 5.0  # ... and at most this share of distinct values: classification
ID_DISTINCT_PCT = 95.0  # numeric column with more than this share distinct ...
ID_DISTINCT_MIN = 50  # ... and more than this many distinct values: an identifier
TEXT_DISTINCT_MAX = 30  # categorical column with more distinct values than this ...
TEXT_DISTINCT_PCT = 40.0  # ... or a larger share than this: free text, dropped
SCALE_SENSITIVE = ("logistic_regression", "linear_regression", "ridge", "lasso", "knn", "svm")
DEFAULT_METRIC = {CLASSIFICATION: "f1", REGRESSION: "rmse"}


class ProblemError(ValueError):
    pass


@dataclass(frozen=True)
class Problem:
    problem_type: str
    target: str
    features: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    metric: str = "f1"


def type_rule(is_categorical: Column, is_numeric: Column, unique_values: Column, unique_pct: Column) -> Column:
    """Classification for categorical or two-valued columns and for numeric columns with
    few distinct values; regression for other numeric columns; NULL when no rule applies."""
    return (
        F.when(is_categorical | (unique_values == 2), F.lit(CLASSIFICATION))
        .when(is_numeric & (unique_values <= MAX_CLASS_DISTINCT) & (unique_pct <= MAX_CLASS_DISTINCT_PCT), F.lit(CLASSIFICATION))
        .when(is_numeric, F.lit(REGRESSION))
    )


def problem_type_by_column(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The inferred problem type were each column the target: ``column_name, position,
    problem_type`` (NULL when the type cannot be inferred, e.g. a datetime column)."""
    prof = profile if profile is not None else column_profile(df)
    return prof.select(
        "column_name",
        "position",
        type_rule(F.col("is_categorical"), F.col("is_numeric"), F.col("unique_values"), F.col("unique_percentage")).alias(
            "problem_type"
        ),
    )


def resolve_problem(
    df: DataFrame,
    target: str | None = None,
    problem_type: str = "auto",
    excluded: tuple[str, ...] | list[str] = (),
    metric: str | None = None,
) -> Problem:
    """Target (default: the last column), problem type, features and metric."""
    cols = df.columns
    if not cols:
        raise ProblemError("the table has no columns")
    target = cols[-1] if target is None else target
    if target not in cols:
        raise ProblemError(f"target column {target!r} does not exist")
    unknown = sorted(c for c in excluded if c not in cols)
    if unknown:
        raise ProblemError(f"excluded column(s) do not exist: {unknown}")
    if target in excluded:
        raise ProblemError("the target may not be excluded")
    if problem_type in (CLASSIFICATION, REGRESSION):
        kind = problem_type
    elif problem_type == "auto":
        row = problem_type_by_column(df.select(target)).first()
        kind = row["problem_type"]
        if kind is None:
            raise ProblemError(
                f"problem type cannot be inferred for target {target!r} of type {df.schema[target].dataType.simpleString()}"
            )
    else:
        raise ProblemError(f"unsupported problem type {problem_type!r}")
    ex = set(excluded)
    features = tuple(c for c in cols if c != target and c not in ex)
    if not features:
        raise ProblemError("no feature columns remain after removing the target and excluded columns")
    return Problem(kind, target, features, tuple(excluded), metric or DEFAULT_METRIC[kind])


def infer_problem_table(df: DataFrame, target: str | None = None, **kw) -> DataFrame:
    """The resolved problem as one row per feature: ``target, problem_type, metric,
    feature, position``."""
    p = resolve_problem(df, target, **kw)
    rows = [(p.target, p.problem_type, p.metric, f, i) for i, f in enumerate(p.features)]
    return df.sparkSession.createDataFrame(
        rows, "target string, problem_type string, metric string, feature string, position int"
    )


def recommend_actions(df: DataFrame, target: str, families: tuple[str, ...] = (), profile: DataFrame | None = None,
                      excluded=()) -> DataFrame:
    """Recommended action per feature column: ``column_name, position, action, impute,
    scale``. ``action`` is drop, keep (numeric), one_hot, datetime_extract or passthrough;
    ``impute`` is median (numeric), mode (categorical) or NULL; ``scale`` is standard for
    kept numeric columns when any model family is scale sensitive.
    """
    prof = profile if profile is not None else column_profile(df)
    name = F.lower(F.col("column_name"))
    is_id = (
        name.endswith(ID_SUFFIX)
        | name.isin(*ID_NAMES)
        | (F.col("is_numeric") & (F.col("unique_percentage") > ID_DISTINCT_PCT) & (F.col("unique_values") > ID_DISTINCT_MIN))
    )
    is_text = F.col("is_categorical") & ((F.col("unique_values") > TEXT_DISTINCT_MAX) | (F.col("unique_percentage") > TEXT_DISTINCT_PCT))
    drop = is_id | is_text
    action = (
        F.when(drop, "drop")
        .when(F.col("is_numeric"), "keep")
        .when(F.col("is_categorical"), "one_hot")
        .when(F.col("is_datetime"), "datetime_extract")
        .otherwise("passthrough")
    )
    missing = F.col("missing_count") > 0
    impute = F.when(~drop & F.col("is_numeric") & missing, "median").when(
        ~drop & ~F.col("is_numeric") & F.col("is_categorical") & missing, "mode"
    )
    sensitive = any(f in SCALE_SENSITIVE for f in families)
    scale = F.when(F.lit(sensitive) & ~drop & F.col("is_numeric"), "standard")
    feats = prof.where((F.col("column_name") != target) & ~F.col("column_name").isin(*(list(excluded) or [""])))
    return feats.select("column_name", "position", action.alias("action"), impute.alias("impute"), scale.alias("scale"))


@dataclass
class ColumnPlan:
    drop: list[str] = field(default_factory=list)
    impute_median: list[str] = field(default_factory=list)
    impute_mode: list[str] = field(default_factory=list)
    one_hot: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)
    scale: list[str] = field(default_factory=list)


def column_plan(actions: DataFrame) -> ColumnPlan:
    """Collect the (one row per column) action table into step argument lists."""
    plan = ColumnPlan()
    for r in actions.orderBy("position").collect():
        c = r["column_name"]
        if r["action"] == "drop":
            plan.drop.append(c)
            continue
        if r["impute"] == "median":
            plan.impute_median.append(c)
        elif r["impute"] == "mode":
            plan.impute_mode.append(c)
        if r["action"] == "one_hot":
            plan.one_hot.append(c)
        elif r["action"] == "datetime_extract":
            plan.datetime.append(c)
        elif r["action"] == "passthrough":
            plan.passthrough.append(c)
        if r["scale"] == "standard":
            plan.scale.append(c)
    return plan
