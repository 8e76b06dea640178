"""Approximate nearest neighbours by an adaptive dimension scan within inverted lists.

1. Fit on a bounded sample: list centres (k-means), a random rotation, and the number of lists
   to probe, the least for which the probed lists hold ``TARGET`` of the sample queries' true
   neighbours.
2. Each vector goes to its nearest list. Of equal vectors only the k + 1 smallest ids are kept:
   more can never be among any query's k nearest, ties going to smaller ids. So a vector that
   a third of the rows share is k + 1 rows.
3. Each query goes to its probed lists. Lists are cut into parts of ``PART`` vectors and blocks
   of ``PART`` queries at most; a (list, part, block) is one group of one task.
4. In a group the rotated vectors are scanned in column blocks. A rotated prefix is a random
   projection: its length, scaled up, estimates the distance. Pairs whose estimate exceeds the
   query's bound by more than the test allows (``EPSILON`` standard deviations of the estimate,
   shrinking as more columns are read) are given up. The bound is the query's k-th distance
   within the sample, a row for each id, which can't be less than the true one. Survivors get
   the exact distance on the original vectors in double precision.
5. The groups' best k of each query meet, and the best k of all remain.
6. A query that is left with fewer than k (true neighbours in lists it doesn't probe, or given
   up by the test) scans its probed lists again without a bound.

Edge cases: vectors that are null, empty, zero, hold null or non-finite components, or do not
have the most common length (the longer of equally common ones) take no part, as queries or as
candidates; a null id takes no part; rows of equal id and vector count once, and a query's own
id is never a candidate; fewer candidates than k: all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.scratch import written

K = 10
#: Bound of the sample to which lists, probes and bounds are fitted.
SAMPLE = 20_000
BOUNDS = 2_000
TARGET = 0.97
MAX_LISTS = 1024
#: Vectors and queries of a group.
PART = 20_000
COLUMNS = 16
EPSILON = 2.1


@dataclass
class Index:
    """Fitted on the sample; its size doesn't grow with the table."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    ids: np.ndarray
    vectors: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        """Lists of each vector, the nearest first."""
        return np.argsort(_squares(x, self.centres), axis=1, kind="stable")

    def bounds(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of each query's k-th squared distance."""
        if len(self.ids) < k + 1:
            return np.full(len(x), np.inf)
        d = _squares(x, self.vectors)  # a row for each id, so k of them are k candidates
        d[ids[:, None] == self.ids[None, :]] = np.inf
        return np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _means(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(12):
        own = np.argmin(_squares(x, centres), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=lists)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int, target: float, rng: np.random.Generator) -> int:
    """Lists to probe so that they hold ``target`` of sample queries' neighbours."""
    queries = rng.choice(len(x), min(300, len(x)), replace=False)
    own = np.argmin(_squares(x, centres), axis=1)
    rank = np.argsort(np.argsort(_squares(x[queries], centres), axis=1), axis=1)
    d = _squares(x[queries], x)
    d[np.arange(len(queries)), queries] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    found = np.take_along_axis(rank, own[near], axis=1).ravel()
    if not len(found):
        return len(centres)
    share = np.cumsum(np.bincount(found, minlength=len(centres))) / len(found)
    return int(np.searchsorted(share, target) + 1)


def fit(distinct: DataFrame, rows: int, k: int, target: float) -> Index:
    """Lists, rotation and probes from about ``SAMPLE`` vectors, chosen by a hash of the id;
    ``distinct`` has a row for each id and vector."""
    spot = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000))
    sample = distinct.where(spot < math.ceil(min(1.0, SAMPLE / max(rows, 1)) * 1_000_000)).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    ids = sample.column("vec_id").to_numpy()
    x = _matrix(sample.column("vector").combine_chunks(), len(ids))
    rng = np.random.default_rng(7)
    rotation, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    lists = max(1, min(MAX_LISTS, round(math.sqrt(rows) / 4), len(x) // 20))
    centres = _means(x, lists, rng) if len(x) else x
    once = np.unique(ids, return_index=True)[1][:BOUNDS]
    return Index(centres, rotation, _probes(x, centres, k, target, rng) if len(x) else 0, ids[once], x[once])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, rotation: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (candidate, query) that the adaptive scan doesn't give up."""
    dim = x.shape[1]
    rx, rq = x @ rotation, q @ rotation
    so_far = np.zeros(0)
    i = j = np.zeros(0, np.int64)
    for lo in range(0, dim, COLUMNS):
        hi = min(lo + COLUMNS, dim)
        a, b = rx[:, lo:hi], rq[:, lo:hi]
        if lo == 0:
            d = _squares(a, b)
        else:
            so_far = so_far + ((a[i] - b[j]) ** 2).sum(1)
        slack = (1 + epsilon / math.sqrt(hi)) ** 2 * hi / dim if hi < dim else 1 + 1e-9
        if lo == 0:
            i, j = np.nonzero(d <= bound[None, :] * slack + 1e-9)
            so_far = d[i, j]
        else:
            keep = so_far <= bound[j] * slack + 1e-9
            i, j, so_far = i[keep], j[keep], so_far[keep]
    return i, j


def _best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    step = max(1, 2_000_000 // max(len(x), 1))
    for lo in range(0, len(q), step):
        i, j = scan(x, q[lo : lo + step], bound[lo : lo + step], rotation)
        j = j + lo
        other = ids[i] != q_ids[j]
        i, j = i[other], j[other]
        d = np.sqrt(((x[i] - q[j]) ** 2).sum(1))
        order = np.lexsort((ids[i], d, j))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(j, j)
        keep = np.arange(len(j)) - first < k
        out.append((q_ids[j[keep]], ids[i[keep]], d[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _valid(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col("vector")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0))


def search(table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, target: float = TARGET) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance): the ``k``
    nearest found of each row of ``table`` for which ``is_query`` (over ``vec_id``) holds."""
    spark = table.sparkSession
    valid = _valid(table, vec_id, vector)
    # repeated rows count once, in the sample as well
    valid = written(valid.groupBy("vec_id", "vector").agg(F.lit(1).alias("one")).select("vec_id", "vector"), "distinct")
    sizes = valid.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.size("vector") == sizes[0].dim)
    index = fit(valid, sizes[0].n, k, target)
    sent = spark.sparkContext.broadcast(index)  # SAMPLE bounds it
    nearest_ids = Window.partitionBy("vector").orderBy("vec_id")
    kept = valid.withColumn("nth", F.row_number().over(nearest_ids)).where(F.col("nth") <= k + 1).select("vec_id", "vector")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = sent.value.lists(_matrix(batch.column(1), batch.num_rows))[:, 0]
                yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32))], names=["vec_id", "vector", "list"])

    filed = written(kept.mapInArrow(assign, "vec_id long, vector array<double>, list int"), "lists")
    held = {r.list: r.n for r in filed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS rows
    lists = len(index.centres)
    n_held = np.array([held.get(i, 0) for i in range(lists)])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, ids = sent.value, batch.column(0).to_numpy()
            x = _matrix(batch.column(1), batch.num_rows)
            order = own.lists(x)
            # more lists where the first ones hold too few vectors
            enough = (np.cumsum(n_held[order], axis=1) - n_held[order]) <= k
            picked = (np.arange(lists)[None, :] < own.probes) | enough
            rows, at = np.nonzero(picked)
            yield pa.record_batch([pa.array(ids[rows]), batch.column(1).take(pa.array(rows)), pa.array(own.bounds(ids, x, k)[rows]), pa.array(order[rows, at].astype(np.int32))], names=["vec_id", "vector", "bound", "list"])

    asked = valid.where(is_query)
    asked = written(asked.mapInArrow(probe, "vec_id long, vector array<double>, bound double, list int"), "queries")

    def cut(count: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(math.ceil(max(count.get(i, 0), 1) / PART)) for i in range(lists)]), F.col("list") + 1)

    def spread(rows: DataFrame, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        """A row's own part, and all parts of the other side."""
        mine = F.pmod(F.xxhash64("vec_id"), own).cast("int").alias(names[0])
        return rows.select("*", mine, F.explode(F.sequence(F.lit(0), other.cast("int") - 1)).alias(names[1]))

    def group(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = candidates.combine_chunks(), queries.combine_chunks()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            x, q = (_matrix(t.column("vector").combine_chunks(), t.num_rows) for t in (a, b))
            found = _best(a.column("vec_id").to_numpy(), x, b.column("vec_id").to_numpy(), q, b.column("bound").to_numpy(), sent.value.rotation, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    def met(asked: DataFrame) -> DataFrame:
        """The best k of each query and group."""
        queries = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS rows
        parts, blocks = cut(held), cut(queries)
        wanted = filed.where(F.col("list").isin(list(queries)))
        left = spread(wanted, parts, blocks, ("part", "block")).groupBy("list", "part", "block")
        right = spread(asked, blocks, parts, ("block", "part")).groupBy("list", "part", "block")
        return left.cogroup(right).applyInArrow(group, "query_id long, vec_id long, score double")

    near = written(met(asked), "near")
    full = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = asked.join(full, asked.vec_id == full.query_id, "left_anti")
    again = written(met(short.withColumn("bound", F.lit(float("inf")))), "again")
    near = near.join(full, "query_id", "left_semi").unionByName(again)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
