"""Exact top-k: equal to brute force at any part size, hot vectors, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA)


def brute(rows, every, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.floor(np.array([v for _, v in rows], dtype=np.float32).astype(np.float64) * 1024).astype(np.int64)
    out = {}
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % every == 0:
            near = sorted((-int(s), int(j)) for s, j in zip(x @ q, ids, strict=True) if j != i)[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("part_bytes", [30_000, 16_000_000])
def test_equals_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(top_k, "PART_BYTES", part_bytes)
    monkeypatch.setattr(top_k, "TILE", 20_000)
    monkeypatch.setattr(top_k, "SAMPLE", 300)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 40)).astype(np.float32) * np.linspace(2, 0.1, 40, dtype=np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:2000] = x[7]  # a vector that a third of the rows share
    rows = [(int(i) * 3, v.tolist()) for i, v in zip(rng.permutation(3000), x, strict=True)]
    assert answers(top_k.search(frame(spark, rows), F.col("vec_id") % 25 == 0)) == brute(rows, 25)


@pytest.mark.parametrize("share", [0.0, 1.1])
def test_whole_columns_and_pairs_agree(monkeypatch, share):
    monkeypatch.setattr(top_k, "SPARSE", share)
    rng = np.random.default_rng(2)
    x, q = rng.integers(-1000, 1000, (500, 50)), rng.integers(-1000, 1000, (30, 50))
    full = x @ q.T
    floors = -np.sort(-full, axis=0)[9]
    plan = top_k.Plan(rng.permutation(50), np.arange(0), x[:0], "<i4", True)
    parts = []
    for m in (x, q):
        entries = list(top_k.pack(np.arange(len(m)), m, np.zeros(len(m), np.int64), plan))
        blocks = [np.frombuffer(e["columns"], "<i4").reshape(-1, len(m)).astype(float) for e in entries]
        parts += [blocks, [np.frombuffer(e["rest"]) for e in entries]]
    i, j, score = top_k.survivors(*parts, floors)
    a, b = np.nonzero(full >= floors[None, :])
    assert sorted(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == sorted(zip(a.tolist(), b.tolist(), full[a, b].tolist(), strict=True))


def test_large_components(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 3)) * 1e5).astype(np.float32)  # sums pass 2^53
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert answers(top_k.search(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows, 10)


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(OverflowError):
        top_k.search(frame(spark, [(0, [1e9, 1.0]), (1, [1e9, 1.0])]), F.col("vec_id") % 10 == 0)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.0]), (0, [0.5, 0.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]),
            (6, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (9, [0.25, 1.0]), (8, [0.25, 3.0]), (None, [1.0, 1.0]), (100, [-0.5, 0.0])]
    got = answers(top_k.search(frame(spark, rows), F.col("vec_id") % 100 == 0))
    # zero vectors take part; ties go to the smaller id; repeats of a row are one row
    assert got[0] == [(1, 8, 512 * 256), (2, 9, 512 * 256), (3, 6, 0), (4, 100, -512 * 512)]
    assert got[100] == [(1, 6, 0), (2, 8, -512 * 256), (3, 9, -512 * 256), (4, 0, -512 * 512)]


def test_empty(spark):
    for rows in ([], [(1, [1.0])], [(0, None)]):
        out = top_k.search(frame(spark, rows), F.col("vec_id") % 100 == 0)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
    assert top_k.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
