"""Nearest neighbours: recall against brute force, exact scores, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, vector int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA)


def brute(rows, every, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            near = sorted((float(s), int(j)) for s, j in zip(d, ids, strict=True) if j != i)[:k]
            out[i] = near
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("part", [150, 20_000])
def test_recall_and_scores(spark, monkeypatch, part):
    monkeypatch.setattr(nn, "PART", part)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1400] = x[7]  # a hot vector
    rows = [(int(i) * 3, v.tolist()) for i, v in zip(rng.permutation(3000), x, strict=True)]
    want, got = brute(rows, 25), answers(nn.search(frame(spark, rows), F.col("vec_id") % 25 == 0))
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, 11))
        exact = dict((j, s) for s, j in brute(rows, 25, 3000)[q]) if q == min(want) else None
        assert exact is None or all(abs(exact[j] - s) < 1e-9 for _, j, s in got[q])
        assert [(s, j) for _, j, s in got[q]] == sorted((s, j) for _, j, s in got[q])
        hits += len({j for _, j, _ in got[q]} & {j for _, j in near})
    assert hits >= 0.9 * 10 * len(want)
    hot = [q for q, v in rows if q % 25 == 0 and v == x[7].tolist()]
    assert hot and all([j for _, j, _ in got[q]] == [j for _, j in want[q]] for q in hot)


def test_scan_gives_up_few_true_neighbours():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(40, 64))
    d = nn._squares(x, q)
    bound = np.partition(d, 9, axis=0)[9]
    rotation, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    i, j = nn.scan(x, q, bound, rotation)
    assert len(i) >= 0.97 * (d <= bound).sum() and (d[i, j] <= bound[j] * (1 + 1e-6)).all()


def test_edge_cases(spark):
    ok = [(100, [1.0, 0.0]), (200, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]
    bad = [(300, None), (400, []), (500, [0.0, 0.0]), (600, [float("nan"), 1.0]), (700, [float("inf"), 1.0]), (800, [None, 1.0]), (900, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    got = answers(nn.search(frame(spark, ok + bad), F.col("vec_id") % 100 == 0))
    assert {q: [j for _, j, _ in v] for q, v in got.items()} == {100: [2, 4, 3, 200], 200: [3, 2, 4, 100]}
    assert got[100][0][2] == 0.0 and got[200][0][2] == 2**0.5
    for rows in ([], bad, [(100, [1.0, 2.0])]):
        assert answers(nn.search(frame(spark, rows), F.col("vec_id") % 100 == 0)) == {}


def test_repeated_rows_do_not_tighten_the_bound(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[7]] * 200 + [r for r in rows[40:60] for _ in range(15)]
    got = answers(nn.search(frame(spark, rows), F.col("vec_id") % 20 == 0, target=1.0))
    want = brute(rows[:400], 20)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(want, 10)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)


def test_neighbours_in_other_lists_leave_no_holes(spark):
    x = np.random.default_rng(6).normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(nn.search(frame(spark, rows), F.col("vec_id") % 10 == 0, target=0.7))
    assert len(got) == 150
    for found in got.values():
        assert [r for r, *_ in found] == list(range(1, 11)) and len({j for _, j, _ in found}) == 10
