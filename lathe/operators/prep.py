"""Preprocessing fitted on the training part and applied to any other part.

Each step is fitted with one aggregation over the (lazily transformed) training rows and
brings only its parameters to the driver: a mean, a median, a category list per column.
Applying a fitted chain is a single projection of literals, so it also runs on a
streaming DataFrame.

Encodings of more than ``MAX_CATEGORIES`` categories are the exception: their categories stay a
table (``value``, ``code``), numbered in order without a global sort and joined to the rows.

Column order follows the reference's per-step column transformer: a step's output
columns come first, the untouched columns follow in their previous order.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    clean,
    is_categorical_type,
    is_datetime_type,
    is_missing,
    is_number_type,
    is_numeric_type,
)
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import HOT_SHARE, looked_up, numbered
from ..session import cut_lineage

MAX_CATEGORIES = 1000  # longer category lists are tables, shorter ones literals in the plan

IMPUTE = ("mean", "median", "mode", "constant")
SCALE = ("standard", "minmax", "robust")
DATETIME_PARTS = ("year", "month", "day", "dayofweek", "hour")


class PrepError(ValueError):
    pass


# ----------------------------------------------------------------------------------- steps


@dataclass
class Step:
    columns: list[str]
    step_id: str = ""

    kind = "step"
    family = None  # impute / scale / encode: at most one per column

    def check(self, df: DataFrame) -> None:
        pass

    def fit(self, df: DataFrame) -> "Fitted":
        raise NotImplementedError


@dataclass
class Fitted:
    kind: str
    columns: list[str]
    params: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # name -> DataFrame, for what is too long for a plan

    def outputs(self, df: DataFrame) -> list[tuple[str, Column]]:
        """``(name, expression)`` of this step's output columns."""
        raise NotImplementedError

    def dropped(self) -> list[str]:
        return list(self.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        outs = self.outputs(df)
        out_names = [n for n, _ in outs]
        gone = set(self.dropped()) | set(out_names)
        rest = [F.col(f"`{c}`") for c in df.columns if c not in gone]
        return df.select(*[e.alias(n) for n, e in outs], *rest)

    def to_json(self) -> dict:
        return {"kind": self.kind, "columns": self.columns, "params": self.params, "tables": sorted(self.tables)}


def _need(df: DataFrame, cols, pred, what: str):
    bad = [c for c in cols if not pred(df.schema[c].dataType)]
    if bad:
        raise PrepError(f"{what} needs {bad} to be of a suitable type")


class Drop(Step):
    kind = "drop"

    def fit(self, df):
        return _FittedDrop("drop", self.columns)


class _FittedDrop(Fitted):
    def outputs(self, df):
        return []


class Passthrough(Step):
    kind = "passthrough"

    def fit(self, df):
        return _FittedIdentity("passthrough", self.columns)


class _FittedIdentity(Fitted):
    def outputs(self, df):
        return [(c, F.col(f"`{c}`")) for c in self.columns]


@dataclass
class Impute(Step):
    strategy: str = "mean"
    fill_value: object = 0
    family = "impute"

    @property
    def kind(self):
        return f"impute_{self.strategy}"

    def check(self, df):
        if self.strategy not in IMPUTE:
            raise PrepError(f"unknown imputation strategy {self.strategy!r}")
        if self.strategy in ("mean", "median"):
            _need(df, self.columns, is_number_type, f"{self.strategy} imputation")
        if self.strategy == "mode":
            _need(df, self.columns, is_categorical_type, "mode imputation")

    def fit(self, df):
        cols = self.columns
        if self.strategy == "constant":
            values = {c: self.fill_value for c in cols}
        elif self.strategy == "mean":
            row = df.agg(*[F.avg(clean(c, df.schema[c].dataType)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
            values = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        elif self.strategy == "median":
            values = {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
        else:
            values = most_frequent(df, cols)
        return _FittedImpute(self.kind, cols, {"values": values, "strategy": self.strategy})


def most_frequent(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent present value per column, ties to the smallest value.

    ``groupBy(column, value).count()`` (combined map-side), then per column the value with
    the largest count via ``min_by`` over ``(-count, value)``: no per-column map of all
    distinct values is ever held by one task.
    """
    parts = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        v = F.when(~is_missing(c, dt), F.col(c).cast("string"))
        num = F.col(c).cast("double") if is_numeric_type(dt) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(i).alias("g"), num.alias("num"), v.alias("txt")))
    long = df.select(F.explode(F.array(*parts)).alias("_c")).select("_c.*").where(F.col("txt").isNotNull())
    counts = long.groupBy("g", "num", "txt").count()
    best = counts.groupBy("g").agg(F.min_by("txt", F.struct((-F.col("count")).alias("c"), "num", "txt")).alias("mode"))
    found = {r["g"]: r["mode"] for r in best.collect()}
    out = {}
    for i, c in enumerate(cols):
        v = found.get(i)
        dt = df.schema[c].dataType
        if v is not None and isinstance(dt, T.BooleanType):
            v = v == "true"
        elif v is not None and is_number_type(dt):
            v = float(v) if isinstance(dt, (T.FloatType, T.DoubleType)) else int(v)
        out[c] = v
    return out


class _FittedImpute(Fitted):
    def outputs(self, df):
        out = []
        for c in self.columns:
            v = self.params["values"].get(c)
            if v is None and self.params["strategy"] != "constant":
                continue  # no present value in training: the column is dropped (as sklearn does)
            dt = df.schema[c].dataType
            col = clean(c, dt)
            if self.params["strategy"] in ("mean", "median"):
                out.append((c, F.coalesce(col.cast("double"), F.lit(float(v)))))
            else:
                out.append((c, F.coalesce(col, F.lit(v).cast(dt))))
        return out


@dataclass
class OneHot(Step):
    """``output``: ``columns`` makes a column for each category, ``vector`` one sparse vector
    ``<column>_onehot`` in which the categories have the same order; ``auto`` takes columns up to
    ``MAX_CATEGORIES`` categories. Unseen values have no 1 anywhere."""

    output: str = "auto"
    kind = "one_hot"
    family = "encode"

    def check(self, df):
        if self.output not in ("auto", "columns", "vector"):
            raise PrepError(f"unknown one-hot output {self.output!r}")
        _need(df, self.columns, is_categorical_type, "one-hot encoding")

    def fit(self, df):
        found = categories(df, self.columns, {"auto": MAX_CATEGORIES, "columns": None, "vector": 0}[self.output])
        return _FittedOneHot("one_hot", self.columns, {"categories": found.lists, "sizes": found.sizes, "missing": found.missing}, found.tables)


@dataclass
class Categories:
    """Categories in order: ``lists`` of short columns, ``tables`` of the others (by column:
    ``codes`` and the ``hot`` part of it), how many there are (``sizes``; missing counts), and
    whether missing is one of them."""

    lists: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)
    missing: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)


def categories(df: DataFrame, cols: list[str], limit: int | None) -> Categories:
    """Sorted distinct training values per column, missing last where it occurs.

    Columns of up to ``limit`` categories (null: any number) get a list of texts with ``None``
    for missing; the others a table ``value``, ``code`` without missing, whose code is the last
    one. Values are counted once for all columns, combined map-side.
    """
    by_type: dict = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType, []).append(c)
    out = Categories()
    for dtype, own in by_type.items():
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(own)]))
        counts = cut_lineage(df.select(cells.alias("_c")).select("_c.*").groupBy("g", "v").agg(F.count("*").alias("n")))
        sizes = {r["g"]: r for r in counts.groupBy("g").agg(F.count("v").alias("k"), F.count("*").alias("all"), F.sum("n").alias("n")).collect()}
        short = [i for i in range(len(own)) if i not in sizes or limit is None or sizes[i]["all"] <= limit]
        lists: dict = {i: [] for i in short}
        for r in counts.where(F.col("g").isin(short)).orderBy("g", F.col("v").asc_nulls_last()).select("g", F.col("v").cast("string")).collect() if short else []:
            lists[r["g"]].append(r[1])
        long = [i for i in range(len(own)) if i not in lists]
        ranked = numbered(counts.where(F.col("g").isin(long) & F.col("v").isNotNull()), ["v"], "code", "g") if long else None
        for i, c in enumerate(own):
            out.sizes[c] = sizes[i]["all"] if i in sizes else 0
            out.missing[c] = i in sizes and sizes[i]["all"] > sizes[i]["k"]
            if i in lists:
                out.lists[c] = lists[i]
                continue
            table = ranked.where(F.col("g") == i).select(F.col("v").cast("string").alias("value"), "code", "n")
            out.tables[f"{c}.codes"] = table.select("value", "code")
            out.tables[f"{c}.hot"] = table.where(F.col("n") >= max(1.0, HOT_SHARE * sizes[i]["n"])).select("value", "code")
            out.lists[c] = None
    return out


class _FittedCategories(Fitted):
    """Short columns are projections; long ones are joined with their tables."""

    def short(self) -> list[str]:
        return [c for c in self.columns if self.params["categories"][c] is not None]

    def transform(self, df: DataFrame) -> DataFrame:
        outs = dict(self.outputs(df))
        rest = [c for c in df.columns if c not in self.columns and c not in outs]
        names = list(outs)
        df = df.withColumns({f"_out{i}": e for i, e in enumerate(outs.values())}) if outs else df
        made = {n: F.col(f"_out{i}") for i, n in enumerate(names)}
        order = {c: [n for n, _ in self.outputs_of(df, c)] for c in self.short()}
        for j, c in enumerate(self.columns):
            if c in order:
                continue
            df = looked_up(df, F.col(f"`{c}`").cast("string"), self.tables[f"{c}.codes"], self.tables[f"{c}.hot"], f"_code{j}")
            df, name, value = self.coded(df, c, f"_code{j}")
            order[c], made[name] = [name], value
        return df.select(*[made[n].alias(n) for c in self.columns for n in order[c]], *[F.col(f"`{c}`") for c in rest])

    def outputs_of(self, df: DataFrame, c: str) -> list[tuple[str, Column]]:
        raise NotImplementedError

    def coded(self, df: DataFrame, c: str, code: str) -> tuple[DataFrame, str, Column]:
        """The output of a long column, given the codes of its rows."""
        raise NotImplementedError

    def outputs(self, df):
        return [o for c in self.short() for o in self.outputs_of(df, c)]


class _FittedOneHot(_FittedCategories):
    def outputs_of(self, df, c):
        s = F.col(f"`{c}`").cast("string")
        out = []
        for v in self.params["categories"][c]:
            name = f"{c}_{'nan' if v is None else v}"
            cond = s.isNull() if v is None else (s == F.lit(v))
            out.append((name, F.when(cond, 1.0).otherwise(0.0)))
        return out

    def coded(self, df, c, code):
        size = self.params["sizes"][c]
        # missing has the last place if it occurred in training; what has no place is a vector of zeros
        place = F.when(F.col(f"`{c}`").isNull(), F.lit(size - 1 if self.params["missing"][c] else size)).otherwise(F.coalesce(code, F.lit(size)))
        df = df.withColumn(code, place.cast("double"))
        # the encoder learns the number of places only
        last = df.sparkSession.createDataFrame([(float(max(size - 1, 0)),)], f"{code} double")
        encoder = OneHotEncoder(inputCols=[code], outputCols=[f"{code}_vector"], handleInvalid="keep", dropLast=True)
        return encoder.fit(last).transform(df), f"{c}_onehot", F.col(f"{code}_vector")


@dataclass
class Ordinal(Step):
    kind = "ordinal"
    family = "encode"

    def check(self, df):
        _need(df, self.columns, is_categorical_type, "ordinal encoding")

    def fit(self, df):
        found = categories(df, self.columns, MAX_CATEGORIES)
        lists = {c: None if vs is None else [v for v in vs if v is not None] for c, vs in found.lists.items()}
        return _FittedOrdinal("ordinal", self.columns, {"categories": lists}, found.tables)


class _FittedOrdinal(_FittedCategories):
    def outputs_of(self, df, c):
        cats = self.params["categories"][c]
        s = F.col(f"`{c}`").cast("string")
        code = F.lit(-1.0)
        if cats:
            m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(float(i)))])
            code = F.coalesce(F.try_element_at(m, s), F.lit(-1.0))
        return [(c, F.when(s.isNull(), F.lit(None).cast("double")).otherwise(code))]

    def coded(self, df, c, code):
        return df, c, F.when(F.col(f"`{c}`").isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.col(code).cast("double"), F.lit(-1.0)))


@dataclass
class Scale(Step):
    method: str = "standard"
    family = "scale"

    @property
    def kind(self):
        return f"scale_{self.method}"

    def check(self, df):
        if self.method not in SCALE:
            raise PrepError(f"unknown scaling {self.method!r}")
        _need(df, self.columns, is_number_type, f"{self.method} scaling")

    def fit(self, df):
        cols = self.columns
        params = {}
        if self.method == "standard":
            aggs = []
            for i, c in enumerate(cols):
                x = clean(c, df.schema[c].dataType).cast("double")
                aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}")]
            row = df.agg(*aggs).first()
            for i, c in enumerate(cols):
                s = row[f"s{i}"]
                params[c] = (row[f"a{i}"] or 0.0, s if s and not math.isclose(s, 0.0, abs_tol=1e-300) else 1.0)
        elif self.method == "minmax":
            aggs = []
            for i, c in enumerate(cols):
                x = clean(c, df.schema[c].dataType).cast("double")
                aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
            row = df.agg(*aggs).first()
            for i, c in enumerate(cols):
                lo, hi = row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0
                params[c] = (lo, (hi - lo) if hi != lo else 1.0)
        else:
            qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
            for c in cols:
                q1, q2, q3 = [v if v is not None else 0.0 for v in qs[c]]
                params[c] = (q2, (q3 - q1) if q3 != q1 else 1.0)
        return _FittedScale(self.kind, cols, {"shift_scale": params})


class _FittedScale(Fitted):
    def outputs(self, df):
        out = []
        for c in self.columns:
            shift, scale = self.params["shift_scale"][c]
            x = clean(c, df.schema[c].dataType).cast("double")
            out.append((c, (x - F.lit(float(shift))) / F.lit(float(scale))))
        return out


@dataclass
class DatetimeParts(Step):
    kind = "datetime_parts"

    def check(self, df):
        _need(df, self.columns, is_datetime_type, "datetime parts")

    def fit(self, df):
        return _FittedDatetime("datetime_parts", self.columns)


def datetime_parts(column: str, prefix: str) -> list[tuple[str, Column]]:
    """``(name, expression)`` of the parts of a date or timestamp."""
    fns = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.dayofweek, "hour": F.hour}
    return [(f"{prefix}_{p}", fns[p](F.col(f"`{column}`"))) for p in DATETIME_PARTS]


class _FittedDatetime(Fitted):
    def outputs(self, df):
        return [o for c in self.columns for o in datetime_parts(c, c)]


_FITTED = {
    "drop": _FittedDrop, "passthrough": _FittedIdentity, "one_hot": _FittedOneHot, "ordinal": _FittedOrdinal,
    "datetime_parts": _FittedDatetime,
}


def _fitted_from_json(d: dict, tables: dict | None = None) -> Fitted:
    k = d["kind"]
    cls = _FITTED.get(k) or (_FittedImpute if k.startswith("impute_") else _FittedScale)
    params = d["params"]
    if k.startswith("scale_"):
        params = {"shift_scale": {c: tuple(v) for c, v in params["shift_scale"].items()}}
    if missing := set(d.get("tables", ())) - set(tables or {}):
        raise PrepError(f"the tables {sorted(missing)} of step {k} are not in its text; save and load the model")
    return cls(k, d["columns"], params, tables or {})


# ----------------------------------------------------------------------------------- chain


class PrepPipeline:
    """Steps in order; each fitted on the training rows as transformed by the steps before.

    Argument checks: unique step ids, non-empty known columns, the target is not allowed,
    at most one imputation / scaling / encoding per column, types fit the operation.
    Columns dropped by an earlier step are skipped in later steps.
    """

    def __init__(self, steps: list[Step], target: str | None = None):
        self.steps = steps
        self.target = target
        ids = [s.step_id for s in steps if s.step_id]
        if len(ids) != len(set(ids)):
            raise PrepError("step ids must be unique")
        seen: dict = {}
        for s in steps:
            if not s.columns:
                raise PrepError(f"step {s.step_id or s.kind} names no columns")
            if target is not None and target in s.columns:
                raise PrepError("the target column may not be preprocessed")
            if s.family:
                for c in s.columns:
                    if (c, s.family) in seen:
                        raise PrepError(f"column {c!r} has more than one {s.family} step")
                    seen[(c, s.family)] = True

    def fit(self, df: DataFrame) -> "PrepModel":
        current = df
        dropped: set = set()
        fitted = []
        for s in self.steps:
            unknown = [c for c in s.columns if c not in current.columns and c not in dropped]
            if unknown:
                raise PrepError(f"unknown column(s) {unknown} in step {s.step_id or s.kind}")
            active = [c for c in s.columns if c not in dropped]
            if not active:
                continue
            step = type(s)(**{**s.__dict__, "columns": active})
            step.check(current)
            f = step.fit(current)
            fitted.append(f)
            if isinstance(s, Drop):
                dropped.update(active)
            current = f.transform(current)
        return PrepModel(fitted)


class PrepModel:
    def __init__(self, fitted: list[Fitted]):
        self.fitted = fitted

    def transform(self, df: DataFrame) -> DataFrame:
        for f in self.fitted:
            df = f.transform(df)
        return df

    def to_json(self) -> str:
        return json.dumps([f.to_json() for f in self.fitted])

    @classmethod
    def from_json(cls, s: str) -> "PrepModel":
        return cls([_fitted_from_json(d) for d in json.loads(s)])

    def save(self, spark, path: str) -> None:
        """Parameters as text, and the tables of long category lists."""
        spark.createDataFrame([(self.to_json(),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/params")
        for i, f in enumerate(self.fitted):
            for j, name in enumerate(sorted(f.tables)):
                f.tables[name].write.mode("overwrite").parquet(f"{path}/tables/{i}-{j}")

    @classmethod
    def load(cls, spark, path: str) -> "PrepModel":
        steps = json.loads(spark.read.json(f"{path}/params").first()["params"])
        return cls([_fitted_from_json(d, {name: spark.read.parquet(f"{path}/tables/{i}-{j}") for j, name in enumerate(d["tables"])}) for i, d in enumerate(steps)])
