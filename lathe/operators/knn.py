"""Exact k nearest neighbours without a cross join, one path for all sizes.

Query and training rows get row numbers of their own (fixed by checkpoints), by which they are
dealt to blocks of about ``BLOCK_BYTES`` of features, whatever ids repeat or are missing; every
(query block, training block) pair meets in one ``cogroup(...).applyInArrow`` task that keeps k
candidates per query, and the candidates are merged by a window partitioned by query. Neither
side goes through the driver.
A task bounds distances by matrix products and measures the pairs that may rank; what it holds
depends on the block size alone.
Ranking is by distance rounded to 9 decimals, then by training row id (missing ones last), rows
of one id by label; the vote takes the most frequent label (ties: the smaller label, in the
label's own type) or the mean for regression; vote shares are the class probabilities.

The cost is the exact method's O(queries x training rows) distance work, spread over all
tasks, and each row is sent once per block of the other side; nothing is capped or sampled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .evaluate import class_values

BLOCK_BYTES = 8 << 20  # feature bytes of one block
_ASKED, _ROWS = 512, 4096  # query and training rows whose distances a task bounds at a time
_PAIRS = 50_000  # pairs measured at a time
_PLAIN = 1e100  # larger values, infinite ones and NaN are ranked one by one


def _distances(q: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs ``(q[i], t[j])`` as they rank: summed column by column, rounded."""
    out = np.zeros(len(i))
    for s in range(0, len(i), _PAIRS):
        gaps = q[i[s:s + _PAIRS]] - t[j[s:s + _PAIRS]]
        gaps *= gaps
        for c in range(gaps.shape[1]):
            out[s:s + _PAIRS] += gaps[:, c]
    return np.round(np.sqrt(out), 9)


def _copies(x: np.ndarray):
    """The first row of each group of equal rows, every row's group and its place in it."""
    x = np.ascontiguousarray(x)
    cells = x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, group = np.unique(cells, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first, group, place


def _topk(q: np.ndarray, t: np.ndarray, k: int):
    """Row indices and distances of the k nearest training rows for each query row (training
    rows are in id order, so the smaller index wins ties; NaN is the largest distance)."""
    k = min(k, t.shape[0])
    at, dist = np.tile(np.arange(k), (q.shape[0], 1)), np.full((q.shape[0], k), np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        rows, asked = (np.abs(x).max(axis=1, initial=0) < _PLAIN for x in (t, q))
        if rows.sum() < k:
            asked[:] = False
        if asked.any():
            at[asked], dist[asked] = _plain_topk(q[asked], t, np.flatnonzero(rows), k)
        # a query with NaN is as far from every row: the first k, as set above
        step = max(1, _ASKED * _ROWS // t.shape[0])
        rest = np.flatnonzero(~asked & ~np.isnan(q).any(axis=1))
        for s in range(0, len(rest), step):
            part = rest[s:s + step]
            i, j = np.repeat(part, t.shape[0]), np.tile(np.arange(t.shape[0]), len(part))
            d = _distances(q, t, i, j).reshape(len(part), -1)
            at[part] = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist[part] = np.take_along_axis(d, at[part], 1)
    return at, dist


def _plain_topk(q: np.ndarray, t: np.ndarray, rows: np.ndarray, k: int):
    """:func:`_topk` of plain values, over the training rows ``rows`` (k at least).

    A matrix product bounds the distances; only pairs that its rounding error leaves among the
    k nearest are measured. Of equal training rows the first k can rank, and equal queries are
    asked once. Rows go in the order of the widest column, and chunks whose bounding boxes lie
    farther apart than the k-th neighbour are passed over."""
    first, group, _ = _copies(q)
    q = q[first]
    rows = rows[_copies(t[rows])[2] < k]
    centre = t[rows].mean(axis=0)
    wide = int(np.argmax(t[rows].std(axis=0)))
    rows = rows[np.argsort(t[rows, wide], kind="stable")]
    near, asked = t[rows] - centre, q - centre
    norms, own = (near ** 2).sum(axis=1), (asked ** 2).sum(axis=1)
    error = 4 * (q.shape[1] + 16) * np.finfo(float).eps * (np.sqrt(own) + np.sqrt(norms.max())) ** 2
    starts = np.arange(0, len(rows), _ROWS)
    low, high = np.minimum.reduceat(near, starts), np.maximum.reduceat(near, starts)
    near = np.column_stack([near, norms, np.ones(len(rows))])

    def limit(d, e):
        """No pair that may rank at the distance ``d`` has a larger product."""
        return (d + 1e-9) ** 2 * (1 + 1e-9) + e

    at, dist = np.full((len(q), k), t.shape[0]), np.full((len(q), k), np.inf)
    order = np.argsort(q[:, wide], kind="stable")
    for s in range(0, len(q), _ASKED):
        part = order[s:s + _ASKED]
        x, e = asked[part], error[part]
        apart = (np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0) ** 2).sum(axis=1) * (1 - 1e-9)
        left = np.column_stack([-2 * x, np.ones(len(part)), own[part]])
        for c in np.argsort(apart, kind="stable"):
            far = limit(dist[part, k - 1], e)
            if apart[c] > far.max():
                break
            begin = starts[c]
            bound = left @ near[begin:begin + _ROWS].T
            if np.isinf(far).any() and bound.shape[1] >= k:
                kth = np.partition(bound, k - 1, axis=1)[:, k - 1]
                far = np.minimum(far, limit(np.sqrt(np.maximum(kth + e, 0)), e))
            i, j = np.nonzero(bound <= far[:, None])
            del bound
            if not len(i):
                continue
            j = rows[begin + j]
            d = _distances(q, t, part[i], j)
            met = np.unique(i)
            i = np.concatenate([np.repeat(met, k), i])
            j, d = (np.concatenate([was[part[met]].ravel(), now]) for was, now in ((at, j), (dist, d)))
            ranked = np.lexsort((j, d, i))
            begins = np.searchsorted(i[ranked], met)
            best = ranked[begins[:, None] + np.arange(k)]
            at[part[met]], dist[part[met]] = j[best], d[best]
    return at[group], dist[group]


class KNNModel:
    def __init__(self, train: DataFrame, features, target, problem_type, k, id_col, classes=None):
        self.train, self.features, self.target = train, features, target
        self.problem_type, self.k, self.id_col, self.classes = problem_type, k, id_col, classes

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], target: str, problem_type: str, k: int = 5,
            id_col: str | None = None):
        if k < 1:
            raise ValueError("k must be at least 1")
        classes = class_values(train, target) if problem_type == "classification" else None
        return cls(train, features, target, problem_type, k, id_col, classes)

    def _vector(self, df: DataFrame):
        if len(self.features) == 1 and isinstance(df.schema[self.features[0]].dataType, T.ArrayType):
            return F.col(self.features[0]).cast("array<double>")
        vectors = [f for f in self.features if isinstance(df.schema[f].dataType, VectorUDT)]
        plain = [F.col(f"`{f}`").cast("double") for f in self.features if f not in vectors]
        return F.concat(F.array(*plain).cast("array<double>"), *[vector_to_array(F.col(f"`{f}`")) for f in vectors])

    def neighbours(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_near``: the k nearest training rows' labels, the nearest first."""
        query = cut_lineage(df.withColumn("_q", F.monotonically_increasing_id()))
        train = self.train
        tid = F.col(self.id_col) if self.id_col else F.xxhash64(*[F.col(c) for c in train.columns])
        kind = T.StringType() if self.problem_type == "classification" else T.DoubleType()
        rows = cut_lineage(train.select(F.monotonically_increasing_id().alias("_t"), tid.alias("_id"), self._vector(train).alias("_x"),
                                        F.col(self.target).cast(kind).alias("_y")))
        asked = query.select("_q", self._vector(query).alias("_x"))

        def blocks(side: DataFrame) -> int:
            size = side.agg((F.count(F.lit(1)) * (F.max(F.size("_x")) * 8 + 64)).alias("b")).first()["b"] or 0
            return max(1, math.ceil(size / BLOCK_BYTES))

        parts, cuts = blocks(rows), blocks(asked)
        cuts = max(cuts, df.sparkSession.sparkContext.defaultParallelism // parts)  # only spreads the work
        left = asked.select("*", F.pmod(F.xxhash64("_q"), F.lit(cuts)).cast("int").alias("_qb"),
                            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_tb"))
        right = rows.select("_id", "_x", "_y", F.pmod(F.xxhash64("_t"), F.lit(parts)).cast("int").alias("_tb"),
                            F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("_qb"))
        schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_id", right.schema["_id"].dataType),
                               T.StructField("_d", T.DoubleType()), T.StructField("_y", kind)])
        k = self.k

        def matrix(table: pa.Table) -> np.ndarray:
            return table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"_q": pa.array([], pa.int64()), "_id": b.column("_id").slice(0, 0), "_d": pa.array([], pa.float64()), "_y": b.column("_y").slice(0, 0)})
            b = b.sort_by([("_id", "ascending"), ("_y", "ascending")])
            i, d = _topk(matrix(a), matrix(b), min(k, b.num_rows))
            at = pa.array(i.ravel())
            return pa.table({"_q": a.column("_q").take(pa.array(np.repeat(np.arange(a.num_rows), i.shape[1]))), "_id": b.column("_id").take(at),
                             "_d": d.ravel(), "_y": b.column("_y").take(at)})

        near = left.groupBy("_qb", "_tb").cogroup(right.groupBy("_qb", "_tb")).applyInArrow(pair, schema)
        nth = F.row_number().over(Window.partitionBy("_q").orderBy("_d", F.asc_nulls_last("_id"), F.asc_nulls_last("_y")))
        best = near.withColumn("_n", nth).where(F.col("_n") <= k)
        lists = best.groupBy("_q").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_y"))), lambda s: s["_y"]).alias("_near"))
        return query.join(lists, "_q").drop("_q")

    def vote(self, found: DataFrame, k: int | None = None) -> DataFrame:
        """Predictions from :meth:`neighbours`, by the nearest ``k`` of them."""
        near = F.slice("_near", 1, k or self.k)
        made = ("prediction", "probabilities", "score") if self.problem_type == "classification" else ("prediction",)
        rest = [F.col(f"`{c}`") for c in found.columns if c not in ("_near", *made)]
        if self.problem_type != "classification":
            mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near)
            return found.select(*rest, mean.alias("prediction"))
        classes = F.array(*[F.lit(c) for c in self.classes])
        votes = F.transform(classes, lambda c: F.size(F.filter(near, lambda x: x == c)))
        shares = F.transform(votes, lambda n: n / F.size(near))
        return found.select(*rest, F.get(classes, F.array_position(votes, F.array_max(votes)).cast("int") - 1).alias("prediction"),
                            shares.alias("probabilities"), F.element_at(shares, -1).alias("score"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``probabilities`` and ``score``."""
        return self.vote(self.neighbours(df))
