"""Exact and approximate quantiles of many columns at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .columns import clean, is_floating
from .ordering import select_ranks


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot ``cols`` into ``(g = position in cols, x = double)``, missing cells dropped."""
    parts = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        parts.append(F.struct(F.lit(i).alias("g"), (clean(c, dt).cast("double")).alias("x")))
    exploded = df.select(F.explode(F.array(*parts)).alias("_v")).select("_v.g", "_v.x")
    return exploded.where(F.col("x").isNotNull() & ~F.isnan("x"))


ACCURACY = 10_000  # of the sketches that bracket the wanted ranks


def bracket_grid(probs: list[float]) -> list[float]:
    """The shares at which the sketch of :func:`exact_quantiles` is read."""
    step = 2 / ACCURACY
    return sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-step, step)})


def sketched(xs: list[Column], probs: list[float]) -> list[Column]:
    """The aggregates that :func:`exact_quantiles` starts from, for callers that scan the table
    for more: counts ``n0`` ... and sketches ``q0`` ... of the values."""
    grid = bracket_grid(probs)
    return [*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)], *[F.percentile_approx(x, grid, ACCURACY).alias(f"q{i}") for i, x in enumerate(xs)]]


def present(df: DataFrame, c: str) -> Column:
    """A number column as double, missing cells null."""
    x = clean(c, df.schema[c].dataType).cast("double")
    return F.when(~F.isnan(x), x)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], row: Row | None = None) -> dict:
    """Linear-interpolated quantiles (pandas / numpy default, SQL ``quantile_cont``).

    Returns ``{column: [value per prob]}``; a column without present values gives Nones.
    One wide sketch brackets the wanted ranks, one wide count proves the brackets, and only
    the cells inside them (a few in ``ACCURACY``) are unpivoted and ranked. ``row`` holds the
    :func:`sketched` aggregates if the caller has them already.
    """
    if not cols:
        return {}
    xs = [present(df, c) for c in cols]
    step, grid = 2 / ACCURACY, bracket_grid(probs)
    if row is None:
        row = df.agg(*sketched(xs, probs)).first()
    brackets = []  # column, prob, lo, hi
    for i in range(len(cols)):
        for p in probs if row[f"n{i}"] else []:
            lo, hi = (row[f"q{i}"][grid.index(min(1.0, max(0.0, p + d)))] for d in (-step, step))
            brackets.append((i, p, lo if p > step else None, hi if p < 1 - step else None))

    def inside(b):
        i, _, lo, hi = b
        x = xs[i]
        low = F.lit(True) if lo is None else x >= F.lit(lo)
        return x.isNotNull() & low & (F.lit(True) if hi is None else x <= F.lit(hi))

    below: list[int] = []
    sizes: list[int] = []
    if brackets:
        got = df.agg(*[F.count_if(xs[i] < F.lit(lo)).alias(f"b{j}") if lo is not None else F.lit(0).alias(f"b{j}") for j, (i, _, lo, _) in enumerate(brackets)],
                     *[F.count_if(inside(b)).alias(f"s{j}") for j, b in enumerate(brackets)]).first()
        for j, (i, p, lo, hi) in enumerate(brackets):
            n, h = row[f"n{i}"], (row[f"n{i}"] - 1) * p
            if not (got[f"b{j}"] <= math.floor(h) and math.ceil(h) < got[f"b{j}"] + got[f"s{j}"]):
                brackets[j] = (i, p, None, None)  # the sketch missed: all present cells
            whole = brackets[j][2] is None and brackets[j][3] is None
            below.append(0 if whole else got[f"b{j}"])
            sizes.append(n if whole else got[f"s{j}"])
    targets, values = [], {}
    for j, (i, p, lo, hi) in enumerate(brackets):
        h = (row[f"n{i}"] - 1) * p
        if lo is not None and lo == hi:
            values[j] = (lo, lo)
        else:
            targets += [(j, r - below[j]) for r in sorted({math.floor(h), math.ceil(h)})]
    if targets:
        cells = F.array(*[F.when(inside(b), F.struct(F.lit(j).alias("g"), xs[b[0]].alias("x"))) for j, b in enumerate(brackets) if j not in values])
        rest = df.select(F.explode(F.array_compact(cells)).alias("_v")).select("_v.g", "_v.x")
        found = {t: v for t, (v, _) in zip(targets, select_ranks(rest, targets, counts=dict(enumerate(sizes))))}
        for j, (i, p, _, _) in enumerate(brackets):
            if j not in values:
                h = (row[f"n{i}"] - 1) * p
                values[j] = (found[j, math.floor(h) - below[j]], found[j, math.ceil(h) - below[j]])
    out = {c: [None] * len(probs) for c in cols}
    for j, (i, p, _, _) in enumerate(brackets):
        h, (lo, hi) = (row[f"n{i}"] - 1) * p, values[j]
        out[cols[i]][probs.index(p)] = lo + (h - math.floor(h)) * (hi - lo)
    return out


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10000) -> dict:
    """One pass of ``percentile_approx`` sketches (mergeable; bounded memory per task)."""
    if not cols:
        return {}
    row = df.agg(
        *[F.percentile_approx(clean(c, df.schema[c].dataType).cast("double"), probs, accuracy).alias(f"q{i}")
          for i, c in enumerate(cols)]
    ).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> dict:
    return exact_quantiles(df, cols, probs) if exact else approx_quantiles(df, cols, probs)


__all__ = ["exact_quantiles", "approx_quantiles", "quantiles", "long_values", "is_floating"]
