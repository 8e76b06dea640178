"""Feature engineering: products, ratios, differences, log1p, squares, datetime parts.

Steps run in order and may read the outputs of earlier steps; the whole chain is one
``withColumns`` projection per step (Catalyst collapses them into one). What depends on the
data (log1p's domain, square's missing values) is checked in the projection itself: a bad row
raises when it is computed, and no step starts a job of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, is_datetime_type, is_missing
from .prep import DATETIME_PARTS, datetime_parts

OPERATIONS = ("interaction", "ratio", "difference", "log1p", "square", "datetime_parts")


class EngineeringError(ValueError):
    pass


@dataclass
class Feature:
    operation: str
    inputs: tuple[str, ...]
    output: str
    step_id: str = ""


def Interaction(a, b, out, step_id=""):
    return Feature("interaction", (a, b), out, step_id)


def Ratio(a, b, out, step_id=""):
    return Feature("ratio", (a, b), out, step_id)


def Difference(a, b, out, step_id=""):
    return Feature("difference", (a, b), out, step_id)


def Log1p(a, out, step_id=""):
    return Feature("log1p", (a,), out, step_id)


def Square(a, out, step_id=""):
    return Feature("square", (a,), out, step_id)


def DatetimeParts(a, out, step_id=""):
    """Year, month, day, day of week and hour of ``a`` as ``<out>_year`` and so on."""
    return Feature("datetime_parts", (a,), out, step_id)


def outputs(f: Feature) -> list[str]:
    """The columns that a step adds."""
    return [f"{f.output}_{p}" for p in DATETIME_PARTS] if f.operation == "datetime_parts" else [f.output]


def _x(df, c):
    return clean(c, df.schema[c].dataType).cast("double")


def _expr(df: DataFrame, f: Feature):
    op = f.operation
    if op == "interaction":
        return _x(df, f.inputs[0]) * _x(df, f.inputs[1])
    if op == "ratio":  # division by zero gives a missing value
        return F.try_divide(_x(df, f.inputs[0]), F.nullif(_x(df, f.inputs[1]), F.lit(0.0)))
    if op == "difference":
        return _x(df, f.inputs[0]) - _x(df, f.inputs[1])
    if op == "log1p":  # -1 gives -inf, as numpy does
        a = _x(df, f.inputs[0])
        return F.when(a == -1.0, F.lit(float("-inf"))).otherwise(F.log1p(a))
    if op == "square":
        a = _x(df, f.inputs[0])
        return a * a
    raise EngineeringError(f"unsupported operation {op!r}")


def _checked(df: DataFrame, f: Feature):
    """The expression, which raises on a value that the operation does not take."""
    a, value = f.inputs[0], _expr(df, f)
    if f.operation == "log1p":
        bad, what = _x(df, a) < -1.0, "values below -1"
    elif f.operation == "square":
        bad, what = is_missing(a, df.schema[a].dataType), "missing values"
    else:
        return value
    return F.when(bad, F.raise_error(F.lit(f"{f.operation} input {a!r} has {what}")).cast("double")).otherwise(value)


def engineer(df: DataFrame, steps: list[Feature], target: str | None = None, raw_columns=None,
             check: bool = True) -> tuple[DataFrame, list[dict]]:
    """Apply the steps in order. Returns the table and the lineage ``[{step_id, output,
    inputs, status}]``, an entry for each column made. A step whose input existed in the raw
    table but was dropped earlier is skipped; an unknown input is an error; ``custom`` is always
    rejected. With ``check``, a value below -1 (log1p) or missing (square) is an error of the
    action that computes it.
    """
    ids = [s.step_id for s in steps if s.step_id]
    if len(ids) != len(set(ids)):
        raise EngineeringError("step ids must be unique")
    outs = [c for s in steps for c in outputs(s)]
    if len(outs) != len(set(outs)):
        raise EngineeringError("output names must be unique")
    raw = set(raw_columns or [])
    lineage = []
    for s in steps:
        if s.operation == "custom":
            raise EngineeringError("custom operations are not supported; add the column with withColumn")
        if s.operation not in OPERATIONS:
            raise EngineeringError(f"unsupported operation {s.operation!r}")
        if target is not None and (target in s.inputs or target in outputs(s)):
            raise EngineeringError("the target may be neither input nor output of a feature")
        if taken := [c for c in outputs(s) if c in df.columns]:
            raise EngineeringError(f"output {', '.join(map(repr, taken))} already exists")
        missing = [c for c in s.inputs if c not in df.columns]
        skipped = bool(missing) and all(c in raw for c in missing)
        if missing and not skipped:
            raise EngineeringError(f"unknown input column(s) {missing}")
        if not skipped and s.operation == "datetime_parts":
            if not is_datetime_type(df.schema[s.inputs[0]].dataType):
                raise EngineeringError(f"datetime parts need {s.inputs[0]!r} to be a date or a timestamp")
            df = df.withColumns(dict(datetime_parts(s.inputs[0], s.output)))
        elif not skipped:
            df = df.withColumn(s.output, _checked(df, s) if check else _expr(df, s))
        status = "skipped" if skipped else "applied"
        lineage += [{"step_id": s.step_id, "output": c, "inputs": list(s.inputs), "status": status} for c in outputs(s)]
    return df, lineage
