"""Exact top-k inner products by columnar branch and bound.

1. Components become integers (``floor(scale * x)``), so that scores are exact. Rows that share
   an id are one row, the one of the smallest vector; of equal vectors only the k + 1 smallest
   ids are kept, as no other can be among a query's k best (ties go to smaller ids). A vector
   that a third of the rows share is k + 1 rows.
2. A bounded sample gives the order of the dimensions (most mass first) and, for each query, a
   floor: its k-th best score within the sample, which the true one can't be below.
3. Candidates and queries are packed into parts of ``PART_BYTES`` in vertical layout: a row for
   each part and block of ``COLUMNS`` dimensions, holding the block's columns one after another
   and the length of what follows the block (the remaining mass) for each vector.
4. Every part of candidates meets every part of queries in one task, block after block. Partial
   scores are added up; a pair whose partial score plus the product of both remaining masses
   (Cauchy-Schwarz) is below the query's floor is given up. Candidates that no query of the tile
   needs are compacted away, and once few pairs are left only these are computed. Floors rise
   with the scores completed in earlier tiles.
5. The parts' best k of each query meet, and the best k of all remain.

Nothing is approximate: bounds are rounded outward, and ties with the floor stay.

Edge cases: vectors that are null, empty, hold null or non-finite components, or do not have the
most common length (the longer of equally common ones) take no part, as queries or as
candidates; nor do null ids. A query's own id is never a candidate; fewer candidates than k: all
are returned; no rows: an empty result. Scores beyond 64 bits raise an error. Columns other
than the id and the vector are not read, whatever their names.
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
SCALE = 1024
#: Bound of the sample that orders the dimensions and sets the queries' first floors.
SAMPLE = 4_000
#: Dimensions of a block.
COLUMNS = 16
#: Bytes of a part's integers, and the fewest vectors of a part of candidates.
PART_BYTES = 16_000_000
PART_ROWS = 4_096
#: Pairs of a tile, which bound the memory of partial scores.
TILE = 1_000_000
#: Share of a tile's pairs below which the survivors are computed pair by pair.
SPARSE = 0.1


@dataclass
class Plan:
    """Fitted on the sample; its size doesn't grow with the table."""

    order: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    dtype: str
    exact: bool  # float64 products and sums are exact

    def kind(self) -> type:
        return np.float64 if self.exact else np.int64

    def floors(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of each query's k-th best score; the least integer where unknown."""
        out = np.full(len(x), np.iinfo(np.int64).min)
        if len(self.ids) <= k or not len(x):
            return out
        sample = self.vectors.astype(self.kind())
        for lo in range(0, len(x), 1_024):
            scores = (x[lo : lo + 1_024].astype(self.kind()) @ sample.T).astype(np.int64)
            scores[ids[lo : lo + 1_024, None] == self.ids[None, :]] = np.iinfo(np.int64).min
            out[lo : lo + 1_024] = -np.partition(-np.maximum(scores, -np.iinfo(np.int64).max), k - 1, axis=1)[:, k - 1]
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def integers(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id`` and ``vector`` (integers) of the rows that take part, a row for each id."""
    x = F.col("vector")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    whole = F.transform(x, lambda v: F.when(F.abs(v * float(scale)) < 2.0**62, F.floor(v * float(scale))).otherwise(F.raise_error(F.lit("component beyond 64 bits")).cast("long")))
    return rows.select("vec_id", whole.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def pack(ids: np.ndarray, x: np.ndarray, floors: np.ndarray, plan: Plan) -> Iterator[dict]:
    """The vertical layout of a part: one entry for each block of dimensions."""
    x = x[:, plan.order]
    for lo in range(0, x.shape[1], COLUMNS):
        rest = np.sqrt((x[:, lo + COLUMNS :].astype(np.float64) ** 2).sum(1))
        yield {
            "at": lo,
            "ids": ids.astype("<i8").tobytes() if lo == 0 else b"",
            "floors": floors.astype("<i8").tobytes() if lo == 0 else b"",
            "columns": np.ascontiguousarray(x[:, lo : lo + COLUMNS].T).astype(plan.dtype).tobytes(),
            "rest": rest.tobytes(),
        }


@dataclass
class Part:
    ids: np.ndarray
    floors: np.ndarray
    blocks: list[np.ndarray]  # (dimensions of the block, vectors)
    rests: list[np.ndarray]


def unpack(part: pa.Table, plan: Plan) -> Part:
    rows = sorted(part.select(["at", "ids", "floors", "columns", "rest"]).to_pylist(), key=lambda r: r["at"])
    ids = np.frombuffer(rows[0]["ids"], "<i8")
    blocks = [np.frombuffer(r["columns"], plan.dtype).reshape(-1, len(ids)).astype(plan.kind()) for r in rows]
    return Part(ids, np.frombuffer(rows[0]["floors"], "<i8").copy(), blocks, [np.frombuffer(r["rest"]) for r in rows])


def survivors(blocks: list[np.ndarray], rests: list[np.ndarray], q_blocks: list[np.ndarray], q_rests: list[np.ndarray], floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (candidate, query) that may reach the queries' floors, with their scores."""
    n, m = blocks[0].shape[1], q_blocks[0].shape[1]
    rows = np.arange(n)
    low = floors.astype(np.float64) * (1 - np.sign(floors) * 1e-12) - 1
    total = np.zeros((n, m), blocks[0].dtype)
    at, last = 0, len(blocks) - 1
    while True:  # whole columns of the vertical layout, while many pairs live
        total += blocks[at][:, rows].T @ q_blocks[at] if len(rows) < n else blocks[at].T @ q_blocks[at]
        if at == last:
            i, j = np.nonzero(total >= floors[None, :])
            return rows[i], j, total[i, j].astype(np.int64)
        alive = total + np.outer(rests[at][rows], q_rests[at]) * (1 + 1e-9) >= low[None, :]
        some = alive.any(axis=1)
        rows, total, alive = rows[some], total[some], alive[some]
        at += 1
        if alive.sum() < SPARSE * max(alive.size, 1):
            break
    i, j = np.nonzero(alive)
    score, i = total[i, j], rows[i]
    while True:  # pair by pair
        for a, b in zip(blocks[at], q_blocks[at], strict=True):
            score = score + a[i] * b[j]
        if at == last:
            keep = score >= floors[j]
        else:
            keep = score + rests[at][i] * q_rests[at][j] * (1 + 1e-9) >= low[j]
        i, j, score = i[keep], j[keep], score[keep]
        if at == last:
            return i, j, score.astype(np.int64)
        at += 1


def best(candidates: Part, queries: Part, k: int, pairs: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores: the part's k best of each query."""
    m = len(queries.ids)
    floors = queries.floors.copy()
    # few queries a tile, so that a tile spans many candidates and can compact them
    wide = min(m, 256)
    tall = max(1, pairs // max(wide, 1))
    found = []
    for q_lo in range(0, m, wide):
        cut = slice(q_lo, q_lo + wide)
        q_ids = queries.ids[cut]
        q_blocks, q_rests = [b[:, cut] for b in queries.blocks], [r[cut] for r in queries.rests]
        held = (np.zeros(0, np.int64),) * 3
        for lo in range(0, len(candidates.ids), tall):
            some = slice(lo, lo + tall)
            i, j, score = survivors([b[:, some] for b in candidates.blocks], [r[some] for r in candidates.rests], q_blocks, q_rests, floors[cut])
            ids = candidates.ids[some][i]
            other = ids != q_ids[j]
            j, ids, score = (np.concatenate([a, b[other]]) for a, b in zip(held, (j, ids, score), strict=True))
            order = np.lexsort((ids, -score, j))
            j, ids, score = j[order], ids[order], score[order]
            nth = np.arange(len(j)) - np.searchsorted(j, j)
            full = nth == k - 1
            floors[q_lo + j[full]] = np.maximum(floors[q_lo + j[full]], score[full])
            keep = nth < k
            held = j[keep], ids[keep], score[keep]
        found.append((q_ids[held[0]], held[1], held[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def search(table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (inner product of the integer
    vectors): the ``k`` best of each row of ``table`` for which ``is_query`` (over ``vec_id``)
    holds."""
    spark = table.sparkSession
    valid = written(integers(table, vec_id, vector, scale), "integers")
    most = F.max(F.array_max(F.transform("vector", lambda v: F.abs(v)))).alias("most")
    sizes = valid.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked"), most).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes or not sizes[0].asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, rows, asked, most = sizes[0]
    if dim * most**2 >= 2**63:
        raise OverflowError(f"scores of {dim} dimensions up to {most} pass 64 bits")
    valid = valid.where(F.size("vector") == dim)
    plan = _fit(valid, rows, dim, "<i4" if most < 2**31 else "<i8", dim * most**2 < 2**53)
    sent = spark.sparkContext.broadcast(plan)  # SAMPLE bounds it
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = valid.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "vector")

    width = max(1, PART_BYTES // (dim * np.dtype(plan.dtype).itemsize))
    cores = max(1, spark.sparkContext.defaultParallelism)
    parts = max(math.ceil(rows / width), min(2 * cores, math.ceil(rows / PART_ROWS)))
    blocks = math.ceil(asked / width)
    layout = "part int, at int, ids binary, floors binary, columns binary, rest binary"

    def packed(floors: bool):  # noqa: ANN202
        def group(key: tuple, members: pa.Table) -> pa.Table:
            x = _matrix(members.column("vector"), members.num_rows)
            ids = members.column("vec_id").to_numpy()
            least = sent.value.floors(ids, x, k) if floors else np.zeros(0, np.int64)
            rows = [{"part": key[0].as_py(), **row} for row in pack(ids, x, least, sent.value)]
            return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("at", pa.int32()), ("ids", pa.binary()), ("floors", pa.binary()), ("columns", pa.binary()), ("rest", pa.binary())]))

        return group

    def vertical(members: DataFrame, n: int, floors: bool, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("part")
        return written(members.select(part, "vec_id", "vector").groupBy("part").applyInArrow(packed(floors), layout), name)

    left = vertical(kept, parts, False, "candidates").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = vertical(valid.where(is_query), blocks, True, "queries").withColumnRenamed("part", "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if candidates.num_rows and queries.num_rows:
            found = best(unpack(candidates, sent.value), unpack(queries, sent.value), k, TILE)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fit(valid: DataFrame, rows: int, dim: int, dtype: str, exact: bool) -> Plan:
    """The sample is chosen by a hash of the id; at most twice ``SAMPLE`` rows reach the driver."""
    share = math.ceil(min(1.0, SAMPLE / rows) * 1_000_000)
    spot = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000))
    sample = valid.where(spot < share).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    x = _matrix(sample.column("vector"), sample.num_rows).reshape(-1, dim)
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    return Plan(order, sample.column("vec_id").to_numpy(), x, dtype, exact)


def search_sql(k: int = K, scale: int = SCALE, modulus: int = 100) -> str:
    """The same over the table ``embeddings``, for queries whose id ``modulus`` divides."""
    return f"""
WITH whole AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)
), single AS (SELECT vec_id, min(vector) AS vector FROM whole GROUP BY vec_id),
usual AS (SELECT len(vector) AS dim FROM single GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
valid AS (SELECT single.* FROM single, usual WHERE len(vector) = dim),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS score
  FROM valid q JOIN valid c ON q.vec_id % {modulus} = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {k}
"""
