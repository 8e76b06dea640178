import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lathe.operators import profile
from lathe.sources import io


def test_metadata_fixture(spark):
    df = spark.createDataFrame([(25, "Ada", dt.datetime(2026, 1, 1)), (31, "Grace", dt.datetime(2026, 1, 2))],
                               "age bigint, name string, created_at timestamp")
    rows = {r["column_name"]: r for r in io.metadata(df).collect()}
    assert rows["age"]["kind"] == "numeric" and rows["name"]["kind"] == "categorical"
    assert rows["created_at"]["kind"] == "datetime"
    assert rows["age"]["n_rows"] == 2 and rows["age"]["n_columns"] == 3
    assert [r[0] for r in io.preview(df, "age", 5).collect()] == [25, 31]


def test_numeric_stats_fixture(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "A double, B double")
    rows = {r["column_name"]: r for r in profile.numeric_stats(df).collect()}
    a, b = rows["A"], rows["B"]
    assert (a["mean"], a["median"], a["std"], a["min"], a["max"]) == (2.0, 2.0, 1.41, 1.0, 3.0)
    assert (b["mean"], b["median"], b["std"], b["min"], b["max"]) == (0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("values,imbalanced,dist", [
    (["A", "B"] * 4, False, {"A": 4, "B": 4}),
    (["A"] * 9 + ["B"], True, {"A": 9, "B": 1}),
])
def test_class_balance_fixture(spark, values, imbalanced, dist):
    df = spark.createDataFrame([(v,) for v in values], "target string")
    rows = profile.class_balance(df, "target").collect()
    assert {r["class_value"]: r["count"] for r in rows} == dist
    assert all(r["imbalanced"] is imbalanced for r in rows)


def test_class_balance_at_limit(spark):
    df = spark.createDataFrame([(20 + i, t) for i, t in enumerate([0, 0, 0, 0, 1])], "Age bigint, Target bigint")
    rows = profile.class_balance(df, "Target").collect()
    assert {r["class_value"]: r["count"] for r in rows} == {"0": 4, "1": 1}
    assert not rows[0]["imbalanced"]  # 20 % exactly is not below 20 %


def test_class_balance_errors(spark):
    df = spark.createDataFrame([(None,)], "t string")
    with pytest.raises(ValueError):
        profile.check_balance_input(df, "t")
    with pytest.raises(ValueError):
        profile.class_balance(df, "nope")


def test_column_profile_fixture(spark):
    rows = [(i, float(i) if i % 3 else None, f"s{i % 4}", i % 2 == 0, dt.datetime(2026, 1, 1 + i % 5), None)
            for i in range(100)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, t timestamp, n string")
    prof = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert prof["i"]["unique_values"] == 100 and prof["i"]["unique_percentage"] == 100.0
    assert prof["d"]["missing_count"] == 34 and prof["d"]["is_numeric"]
    assert prof["s"]["is_categorical"] and not prof["s"]["is_numeric"]
    assert prof["b"]["is_numeric"] and prof["b"]["is_categorical"]  # bool has both flags
    assert prof["t"]["is_datetime"] and not prof["t"]["is_categorical"]
    assert prof["n"]["unique_values"] == 0 and prof["n"]["missing_percentage"] == 100.0
    approx = {r["column_name"]: r for r in profile.column_profile(df, exact=False).collect()}
    for c in prof:
        assert abs(approx[c]["unique_values"] - prof[c]["unique_values"]) <= max(1, 0.05 * prof[c]["unique_values"])
    samples = profile.sample_values(df).collect()
    by = {}
    for r in samples:
        by.setdefault(r["column_name"], []).append(r)
    assert all(len(v) <= 5 for v in by.values())
    assert "n" not in by  # no nulls in samples
    assert [r["num_value"] for r in sorted(by["i"], key=lambda r: r["rank"])] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert by["t"][0]["text_value"].startswith("2026-01-0")


def test_dataset_context_and_report(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    ctx = profile.dataset_context(o).collect()
    assert [r["column_name"] for r in sorted(ctx, key=lambda r: r["position"])] == o.columns
    assert ctx[0]["n_rows"] == o.count()
    rep = profile.analyze(o, "o_orderstatus")
    sections = {r["section"] for r in rep.collect()}
    assert {"duplicates", "statistics", "profile", "balance"} <= sections


def firsts(rows, columns, n):
    out = {}
    for i, c in enumerate(columns):
        seen = []
        for r in rows:
            if r[i] is not None and r[i] == r[i] and r[i] not in seen:
                seen.append(r[i])
        out[c] = seen[:n]
    return out


@pytest.mark.parametrize("kind", ["parquet", "csv"])
@pytest.mark.parametrize("head", [3, 10_000])
def test_first_values_in_file_order(spark, tmp_path, kind, head):
    """Several files of several splits each; few values, late values, ties with missing cells."""
    rng = random.Random(6)
    rows = [(rng.choice([3, 1, 2]), rng.choice(["b", "a", None]), i // 700, None if i < 3999 else 1.5, float(i % 2) or -0.0, rng.random() < 0.5) for i in range(4000)]
    columns = ["few", "text", "late", "last", "zero", "flag"]
    path = str(tmp_path / f"t.{kind}")
    for i in range(4):
        part = pd.DataFrame(rows[i * 1000 : (i + 1) * 1000], columns=columns).astype({"last": float})
        os.makedirs(path, exist_ok=True)
        name = f"{path}/part-{i}.{kind}"
        part.to_parquet(name, row_group_size=200) if kind == "parquet" else part.to_csv(name, index=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6k")
    try:
        table = io.read_table(spark, path, schema="few int, text string, late int, last double, zero double, flag boolean" if kind == "csv" else None, position=True)
        got = {}
        for r in profile.first_values(table, 4, head=head).orderBy("position", "rank").collect():
            got.setdefault(r.column_name, []).append(r.text_value if r.column_name == "text" else r.num_value)
        assert got == firsts(rows, columns, 4)
        assert [r[:5] for r in map(tuple, io.preview(table, n=1500).select(columns).collect())] == [(a, b, c, d, e) for a, b, c, d, e, _ in rows[:1500]]
        assert io.preview(table).columns == columns
        assert profile.first_values(table.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(io.SourceError):
        io.preview(spark.range(3))


def test_few_passes(spark, sf):
    """The report and the context scan the table a few times, whatever the number of columns."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    counts = {}
    for name, call in (("report", lambda: profile.analyze(orders, "o_orderstatus").collect()), ("context", lambda: profile.dataset_context(orders).collect())):
        group = f"{name}-{random.random()}"
        spark.sparkContext.setJobGroup(group, name)
        call()
        counts[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts["report"] <= 16 and counts["context"] <= 12, counts


def test_report_agrees_with_its_parts(spark, sf):
    table = spark.read.parquet(f"{sf}/part.parquet").withColumn("p_size", F.expr("nullif(p_size, 7)"))
    for exact in (True, False):
        got = {(r.section, r.column_name, r.metric): r.value for r in profile.analyze(table, "p_brand", exact).collect()}
        for r in profile.column_profile(table, exact).collect():
            assert got["profile", r.column_name, "unique_values"] == r.unique_values and got["profile", r.column_name, "missing_percentage"] == r.missing_percentage
        for r in profile.numeric_stats(table, exact).collect():
            assert [got["statistics", r.column_name, m] for m in ("mean", "median", "std", "min", "max")] == [r.mean, r["median"], r["std"], r["min"], r["max"]]
        assert got["missing", "p_size", "missing_count"] == table.where("p_size is null").count() and ("missing", "p_name", "missing_count") not in got
    with pytest.raises(ValueError, match="empty"):
        profile.analyze(table.where("false"))
    assert profile.dataset_context(table.where("false")).agg(F.max("unique_values")).first()[0] == 0


def test_distinct_cells_by_hash(spark):
    nan = float("nan")
    rows = [(0.0, "", {"a": 1}, [1.0, None]), (-0.0, None, {"a": 1}, [1.0]), (nan, "", None, None), (None, "x", {"b": 1}, [1.0])]
    df = spark.createDataFrame(rows, "d double, s string, m map<string,int>, a array<double>")
    assert {r.column_name: r.unique_values for r in profile.column_profile(df).collect()} == {"d": 1, "s": 2, "m": 2, "a": 2}
