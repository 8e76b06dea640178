"""Exact order statistics without a global sort or an unpartitioned window.

Spark has no row order, and a window without ``partitionBy`` sends every row to one task.
Splits, folds, medians and quartiles all need "the value at rank r" (or "is this row
before rank r"), so they share one routine, :func:`select_ranks`:

1. Count the rows of every group (one aggregation).
2. While a target's candidate range still holds more than ``FINAL_LIMIT`` rows, narrow
   it: an approximate quantile grid of the rows in range (``percentile_approx``, a
   mergeable sketch, so a hot group is combined map-side), then one counting pass that
   checks the rank really lies between the two chosen grid values. Each round shrinks
   the range by about ``GRID / 4``; the count check makes the result exact whatever
   the sketch does.
3. Finish with one window per distinct candidate range (shared by the targets of a
   group, e.g. all fold boundaries) over the few rows left in range.

A value repeated in a third of all rows is no problem: its grid points coincide, the
range collapses to that value and the target is resolved without any window.

Only target descriptions (group, rank, bounds) and counts per group reach the driver;
the target table is broadcast up to ``MAX_TARGETS`` rows, beyond that Spark joins it by size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID = 1000  # points of the approximate quantile grid per round
ACCURACY = 100_000  # percentile_approx accuracy (relative rank error 1e-5)
FINAL_LIMIT = 1_000_000  # rows per target that a single window task may sort
MAX_TARGETS = 20_000  # rows of a target table that is broadcast
MAX_GROUPS = 1_000_000  # groups (classes) whose counts the driver keeps


@dataclass
class _Target:
    g: object
    r: int  # wanted rank, 0-based, among the rows of group g
    lo: object = None  # inclusive bounds of the candidate range; None = open
    hi: object = None
    below: int = 0  # rows of the group strictly below lo
    cnt: int = 0  # rows of the group inside [lo, hi]
    margin: int = 2
    value: object = None
    less: int | None = None  # rows of the group strictly below value
    done: bool = False


def group_counts(long_df: DataFrame, g: str = "g") -> dict:
    rows = long_df.groupBy(g).count().limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return {row[0]: row[1] for row in rows}


def _target_frame(spark, targets: list[tuple], gtype: T.DataType, xtype: T.DataType, extra=()) -> DataFrame:
    fields = [
        T.StructField("_tid", T.IntegerType()),
        T.StructField("_tg", gtype),
        T.StructField("_lo", xtype),
        T.StructField("_hi", xtype),
    ] + [T.StructField(name, t) for name, t in extra]
    return small_table(spark.createDataFrame(targets, T.StructType(fields)), len(targets))


def small_table(table: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table of a checked size; a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if rows <= MAX_TARGETS else table


def _in_range(x: Column) -> Column:
    return (F.col("_lo").isNull() | (x >= F.col("_lo"))) & (F.col("_hi").isNull() | (x <= F.col("_hi")))


def select_ranks(long_df: DataFrame, targets: list[tuple], g: str = "g", x: str = "x", counts: dict | None = None):
    """Exact order statistics per group.

    ``long_df`` holds a group column ``g`` and an orderable, non-null value column ``x``.
    ``targets`` is a list of ``(group, rank)`` with 0 <= rank < rows of the group.
    Returns a list of ``(value, n_less)`` in target order: the value at that rank and the
    number of rows of the group strictly below it.
    """
    spark = long_df.sparkSession
    data = long_df.select(F.col(g).alias("_g"), F.col(x).alias("_x"))
    gtype = data.schema["_g"].dataType
    xtype = data.schema["_x"].dataType
    if counts is None:
        counts = group_counts(data, "_g")
    state = []
    for grp, r in targets:
        n = counts.get(grp, 0)
        if not 0 <= r < n:
            raise ValueError(f"rank {r} outside group {grp!r} of {n} rows")
        state.append(_Target(g=grp, r=int(r), cnt=n))

    while big := [i for i, t in enumerate(state) if not t.done and t.cnt > FINAL_LIMIT]:
        before = {i: state[i].cnt for i in big}
        _narrow(spark, data, state, big, gtype, xtype)
        stuck = [i for i in big if not state[i].done and state[i].cnt == before[i] and state[i].margin > GRID]
        if stuck:  # a range that no grid divides, though its bounds differ
            raise RuntimeError(f"the rank search makes no progress in group {state[stuck[0]].g!r}")

    open_ = [i for i, t in enumerate(state) if not t.done]
    if open_:
        _finish(spark, data, state, open_, gtype, xtype)
    return [(t.value, t.less) for t in state]


def _narrow(spark, data, state, idx, gtype, xtype):
    tdf = _target_frame(spark, [(i, state[i].g, state[i].lo, state[i].hi) for i in idx], gtype, xtype)
    in_range = data.join(tdf, data["_g"] == tdf["_tg"]).where(_in_range(F.col("_x")))
    grid = [j / GRID for j in range(GRID + 1)]
    sketches = {
        row["_tid"]: row["q"]
        for row in in_range.groupBy("_tid").agg(F.percentile_approx("_x", grid, ACCURACY).alias("q")).collect()
    }
    proposals = []
    for i in idx:
        t = state[i]
        q = sketches[i]
        pos = (t.r - t.below) / t.cnt * GRID
        jl, jh = math.floor(pos) - t.margin, math.ceil(pos) + t.margin
        lo = t.lo if jl <= 0 else q[jl]
        hi = t.hi if jh >= GRID else q[jh]
        proposals.append((i, t.g, t.lo, t.hi, lo, hi))
    tdf2 = _target_frame(
        spark, proposals, gtype, xtype, extra=(("_nlo", xtype), ("_nhi", xtype))
    )
    x = F.col("_x")
    below_new = (F.col("_nlo").isNotNull()) & (x < F.col("_nlo"))
    inside = (F.col("_nlo").isNull() | (x >= F.col("_nlo"))) & (F.col("_nhi").isNull() | (x <= F.col("_nhi")))
    got = {
        row["_tid"]: (row["nb"], row["ni"])
        for row in data.join(tdf2, data["_g"] == tdf2["_tg"])
        .where(_in_range(x))
        .groupBy("_tid")
        .agg(F.count_if(below_new).alias("nb"), F.count_if(inside).alias("ni"))
        .collect()
    }
    for i, _, _, _, lo, hi in proposals:
        t = state[i]
        nb, ni = got.get(i, (0, 0))
        below = t.below + nb
        if below <= t.r < below + ni:
            if ni == t.cnt:
                t.margin *= 4
            t.lo, t.hi, t.below, t.cnt = lo, hi, below, ni
            if lo is not None and hi is not None and lo == hi:
                t.value, t.less, t.done = lo, below, True
        else:  # the sketch missed: keep the proven range, widen the next proposal
            t.margin *= 4


def _finish(spark, data, state, idx, gtype, xtype):
    """One window per distinct candidate range (targets of one group usually share it:
    the k-1 fold boundaries, a median's two middle ranks), then pick every wanted rank."""
    ranges: dict = {}
    want = []
    for i in idx:
        t = state[i]
        rid = ranges.setdefault((t.g, t.lo, t.hi), len(ranges))
        want.append((i, rid, t.r - t.below + 1))
    rdf = _target_frame(spark, [(rid, g, lo, hi) for (g, lo, hi), rid in ranges.items()], gtype, xtype)
    wdf = small_table(spark.createDataFrame(want, "_tid int, _wid int, _rn long"), len(want))
    w = Window.partitionBy("_tid").orderBy("_x")
    ranked = (
        data.join(rdf, data["_g"] == rdf["_tg"])
        .where(_in_range(F.col("_x")))
        .select(F.col("_tid").alias("_rid"), "_x", F.row_number().over(w).alias("_n"), F.rank().over(w).alias("_rk"))
    )
    picked = ranked.join(wdf, (ranked["_rid"] == wdf["_wid"]) & (ranked["_n"] == wdf["_rn"]))
    for row in picked.select("_tid", "_x", "_rk").collect():
        t = state[row["_tid"]]
        t.value, t.less, t.done = row["_x"], t.below + row["_rk"] - 1, True


def lexi_cutoffs(df: DataFrame, order: tuple[str, str], targets: list[tuple], group: str | None = None,
                 counts: dict | None = None):
    """Cut points in a two-column order ``(a, b)``: for each ``(group, rank)`` the pair
    ``(a*, b*)`` of the row at that rank. ``b`` must make the order total (a unique key).

    Two passes of :func:`select_ranks`: first on ``a``; then on ``b`` among the rows
    whose ``a`` equals the found ``a*`` (usually one row; many when ``a`` has ties).
    """
    a, b = order
    gcol = F.col(group) if group else F.lit(0)
    first = select_ranks(df.select(gcol.alias("g"), F.col(a).alias("x")), targets, counts=counts)
    spark = df.sparkSession
    atype = df.schema[a].dataType
    gtype = df.select(gcol.alias("g")).schema["g"].dataType
    rows = [(i, grp, av) for i, ((grp, _), (av, _)) in enumerate(zip(targets, first))]
    schema = T.StructType([T.StructField("_tid", T.IntegerType()), T.StructField("_tg", gtype), T.StructField("_ta", atype)])
    tdf = small_table(spark.createDataFrame(rows, schema), len(rows))
    ties = (
        df.select(gcol.alias("_g"), F.col(a).alias("_a"), F.col(b).alias("x"))
        .join(tdf, (F.col("_g") == F.col("_tg")) & (F.col("_a") == F.col("_ta")))
        .select(F.col("_tid").alias("g"), "x")
    )
    tie_counts = group_counts(ties, "g")
    second = select_ranks(
        ties, [(i, r - less) for i, ((_, r), (_, less)) in enumerate(zip(targets, first))], counts=tie_counts
    )
    return [(av, bv) for (av, _), (bv, _) in zip(first, second)]


def before(a: Column, b: Column, cut: tuple) -> Column:
    """Row ``(a, b)`` sorts strictly before the cut pair."""
    ca, cb = F.lit(cut[0]), F.lit(cut[1])
    return (a < ca) | ((a == ca) & (b < cb))


def hash_order(key: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order of rows: the first 60 bits of ``md5(key || '|' || seed)``.

    Comparing these numbers orders rows as ``md5(...)`` text does (up to 60-bit ties),
    so an SQL engine can reproduce the order with ``ORDER BY md5(...)``.
    """
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
