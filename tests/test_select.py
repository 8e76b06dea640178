import random

import numpy as np
import pandas as pd
import pytest

from lathe.operators import select


def test_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (3.0, 5.0, 0), (4.0, 5.0, 1)], "A double, B double, target int")
    sel, rep = select.select_features(df, ["A", "B"], "target", "variance")
    assert sel == ["A"]


def test_correlation_default_and_threshold(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0)], "A double, B double")
    assert select.select_features(df, ["A", "B"], "t", "correlation")[0] == ["A"]
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 5.0)], "A double, B double")
    assert select.select_features(df, ["A", "B"], "t", "correlation", threshold=0.95)[0] == ["A"]
    assert select.select_features(df, ["A", "B"], "t", "correlation", threshold=0.99)[0] == ["A", "B"]


def test_correlation_zero_variance_removes_nothing(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "A double, B double")
    assert select.select_features(df, ["A", "B"], "t", "correlation")[0] == ["A", "B"]


def _rank_fixture(spark):
    rnd = random.Random(0)
    rows = [(float(i % 2), rnd.random(), i % 2) for i in range(100)]
    return spark.createDataFrame(rows, "A double, B double, target int")


def test_mutual_info_ranking(spark):
    df = _rank_fixture(spark)
    sel, rep = select.select_features(df, ["B", "A"], "target", "mutual_info", max_features=1)
    assert sel == ["A"]
    ranks = {r["column_name"]: r["rank"] for r in rep.collect()}
    assert ranks == {"A": 1, "B": 2}
    with pytest.raises(select.SelectionError):
        select.select_features(df, ["A", "B"], "target", "mutual_info")
    with pytest.raises(select.SelectionError):
        select.select_features(df, ["A", "B"], "target", "mutual_info", max_features=3)


def test_ties_by_name(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (0.0, 0.0, 0)] * 10, "b double, a double, target int")
    sel, _ = select.select_features(df, ["b", "a"], "target", "mutual_info", max_features=1)
    assert sel == ["a"]


def test_model_based_ranking(spark):
    df = _rank_fixture(spark)
    sel, _ = select.select_features(df, ["B", "A"], "target", "model", max_features=1)
    assert sel == ["A"]


def test_lineage_expansion(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 0)], "x double, c_a double, c_b double, t int")
    sel, _ = select.select_features(df, ["x", "c"], "t", "none", lineage={"c": ["c_a", "c_b"]})
    assert sel == ["x", "c_a", "c_b"]


def test_correlation_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(400, 60)) + 1e6, columns=[f"c{i}" for i in range(60)])
    x["c7"] = 2 * x["c3"] + rng.normal(size=400) * 0.01
    x["c9"] = 7.0
    x = x.mask(rng.random(x.shape) < 0.02)
    cols = list(x.columns)
    got = select.correlation_matrix(spark.createDataFrame(x), cols)
    want = x.corr().abs()
    for (a, b), v in got.items():
        w = want.loc[a, b]
        assert (v is None and np.isnan(w)) or abs(v - w) < 1e-6
    assert [cols[i] for i in select.greedy_removed(select.correlations(spark.createDataFrame(x), cols, 0.95))] == ["c7"]


def greedy(k, edges):
    gone = set()
    for i in range(k):
        if i not in gone:
            gone |= {b for a, b in edges if a == i}
    return sorted(gone)


@pytest.mark.parametrize("limit", [0, 10, 5_000_000])
def test_greedy_rounds(spark, monkeypatch, limit):
    """Rounds in Spark and the ordered stream remove the same; a chain, a star and random edges."""
    monkeypatch.setattr(select, "EDGES", limit)
    rng = random.Random(8)
    graphs = [[(i, i + 1) for i in range(9)], [(3, j) for j in range(4, 30)], [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.1], []]
    for edges in graphs[: 4 if limit else 3]:
        assert select.greedy_removed(spark.createDataFrame(edges, "i int, j int")) == greedy(40, edges)


@pytest.mark.parametrize("cells", [30, 1_500_000])
def test_wide_and_narrow_sums_agree(spark, monkeypatch, cells):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(500, 7)) + 1e6, columns=[f"c{i}" for i in range(7)])
    x["c3"] = x["c1"] * 2 + rng.normal(size=500) * 0.05
    x["c4"] = 5.0
    x.loc[rng.random(500) < 0.2, "c2"] = None
    df, cols = spark.createDataFrame(x), list(x.columns)
    narrow = select.correlation_matrix(df, cols)
    monkeypatch.setattr(select, "NARROW", 1)
    monkeypatch.setattr(select, "CELLS", cells)
    wide = select.correlation_matrix(df, cols)
    want = x.corr().abs()
    for a in cols:
        for b in cols:
            if a != b:
                assert (narrow[a, b] is None) == (wide[a, b] is None) == bool(np.isnan(want.loc[a, b]))
                assert narrow[a, b] is None or abs(narrow[a, b] - want.loc[a, b]) < 1e-7 and abs(narrow[a, b] - wide[a, b]) < 1e-9
    assert select.select_features(df, cols, "t", "correlation", 0.9)[0] == [c for c in cols if c != "c3"]


def test_three_thousand_columns(spark):
    """Only the pairs over the threshold leave the tasks; every tenth column repeats its neighbour."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3000))
    x[:, 9::10] = x[:, 8::10] * -3 + 1
    x[:, 100] = x[:, 8]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(3000)]))
    got, _ = select.select_features(df, df.columns, "t", "correlation", 0.999)
    assert got == [c for i, c in enumerate(df.columns) if i % 10 != 9 and i != 100]
