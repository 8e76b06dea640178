import datetime as dt

import pytest
from pyspark.sql import functions as F

from lathe.functions import ordering
from lathe.operators import split


def _fixture(spark, n=100):
    rows = [(i, float(i % 50 + 20), "sales" if i % 2 else "engineering", dt.date(2024, 1, 1) + dt.timedelta(days=i),
             0 if i < n // 2 else 1) for i in range(n)]
    return spark.createDataFrame(rows, "id int, age double, department string, signup_date date, churn int")


def test_random_split_sizes_and_determinism(spark):
    df = _fixture(spark)
    a = split.split_random(df, "id", 0.2, 42)
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"train": 80, "test": 20}
    b = split.split_random(df, "id", 0.2, 42)
    assert sorted(a.where("split = 'test'").select("id").collect()) == sorted(b.where("split = 'test'").select("id").collect())
    c = split.split_random(df, "id", 0.2, 7)
    assert sorted(a.where("split = 'test'").collect()) != sorted(c.where("split = 'test'").collect())
    assert split.split_random(df, "id", 0.25).where("split = 'test'").count() == 25


def test_stratified_keeps_shares(spark):
    df = _fixture(spark)
    s = split.split_stratified(df, "id", "churn", 0.2, 42)
    got = {(r["churn"], r["split"]): r["count"] for r in s.groupBy("churn", "split").count().collect()}
    assert got == {(0, "test"): 10, (1, "test"): 10, (0, "train"): 40, (1, "train"): 40}


def test_stratified_fallback(spark):
    df = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "id int, y string")
    s = split.split_stratified(df, "id", "y", 0.2)
    assert s.where("split = 'test'").count() == 2


def test_time_split_newest_rows_test(spark):
    df = _fixture(spark)
    s = split.split_time(df, "signup_date", "id", 0.2)
    test_ids = sorted(r["id"] for r in s.where("split = 'test'").collect())
    assert test_ids == list(range(80, 100))
    with pytest.raises(ValueError):
        split.split_time(df, "age", "id", 0.2)


@pytest.mark.parametrize("share,train,test", [(0.01, 9, 1), (0.99, 1, 9)])
def test_time_split_clamps(spark, share, train, test):
    df = _fixture(spark, 10)
    s = split.split_time(df, "signup_date", "id", share)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": train, "test": test}


def test_kfold_sizes(spark):
    df = _fixture(spark, 103)
    f = split.kfold(df, "id", 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    s = split.kfold_stratified(df, "id", "churn", 5)
    per = {(r["fold"], r["churn"]): r["count"] for r in s.groupBy("fold", "churn").count().collect()}
    assert all(10 <= v <= 11 for v in per.values())
    totals = sorted(r["count"] for r in s.groupBy("fold").count().collect())
    assert totals[-1] - totals[0] <= 1


def test_kfold_stratified_small_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(13)], "id int, y string")
    s = split.kfold_stratified(df, "id", "y", 5)  # smallest class has 3 rows: 3 folds
    assert s.select(F.max("fold")).first()[0] == 2


def test_narrowing_path_matches_direct(spark, sf, monkeypatch):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    direct = {r["o_orderkey"]: r["fold"] for r in split.kfold(o, "o_orderkey", 4).collect()}
    monkeypatch.setattr(ordering, "FINAL_LIMIT", 50)
    narrowed = {r["o_orderkey"]: r["fold"] for r in split.kfold(o, "o_orderkey", 4).collect()}
    assert direct == narrowed


def test_select_ranks_skewed_exact(spark, monkeypatch):
    import numpy as np

    rows = [(0, 7.0 if i % 3 == 0 else float(i * 37 % 1001)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double")
    monkeypatch.setattr(ordering, "FINAL_LIMIT", 100)
    xs = np.sort(np.array([r[1] for r in rows]))
    ranks = [0, 500, 1500, 2999]
    got = ordering.select_ranks(df, [(0, r) for r in ranks])
    assert [v for v, _ in got] == [xs[r] for r in ranks]
    assert [less for _, less in got] == [int((xs < xs[r]).sum()) for r in ranks]


def test_hash_threshold_split(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    a = split.split_random(o, "o_orderkey", 0.2, 42, exact=False)
    n, t = o.count(), a.where("split = 'test'").count()
    assert abs(t - 0.2 * n) < 4 * (0.2 * 0.8 * n) ** 0.5  # right in expectation, no job needed
    b = split.split_random(o, "o_orderkey", 0.2, 42, exact=False)
    assert a.where("split = 'test'").select("o_orderkey").collect() == b.where("split = 'test'").select("o_orderkey").collect()


def test_thirty_thousand_classes(spark):
    n = 30_000
    df = spark.range(5 * n).withColumn("c", F.col("id") % n)
    got = split.kfold_stratified(df, "id", "c", 5).groupBy("c").agg(F.count_distinct("fold").alias("k")).groupBy("k").count().collect()
    assert [(r["k"], r["count"]) for r in got] == [(5, n)]


@pytest.mark.parametrize("kind", ["int", "string", "timestamp"])
def test_class_tables_equal_the_driver_s(spark, monkeypatch, kind):
    """The same rows for classes kept in tables; one class holds a third of the rows."""
    i = F.col("id")
    n = F.when(i % 3 == 0, 0).otherwise(1 + (i * 31) % 57)
    cls = {"int": n.cast("int"), "string": F.concat(F.lit("c"), n), "timestamp": F.timestamp_seconds(n * 1000)}[kind]
    df = spark.range(4001).select(F.concat(F.lit("k"), i).alias("key"), cls.alias("y"), i.alias("rest"))
    calls = (lambda d: split.split_stratified(d, "key", "y", 0.3, 7), lambda d: split.split_stratified(d, "key", "y", 0.004), lambda d: split.kfold_stratified(d, "key", "y", 5),
             lambda d: split.kfold_stratified(d.where("rest < 400"), "key", "y", 4))
    want = [sorted(map(str, call(df).collect())) for call in calls]
    monkeypatch.setattr(split, "DRIVER_CLASSES", 3)
    got = [call(df) for call in calls]
    assert [sorted(map(str, g.collect())) for g in got] == want and got[0].columns == ["key", "y", "rest", "split"]
    with pytest.raises(ValueError, match="missing"):
        split.split_stratified(df.withColumn("y", F.when(F.col("rest") % 2 == 0, F.col("y"))), "key", "y")


def test_fallbacks_of_class_tables(spark, monkeypatch):
    monkeypatch.setattr(split, "DRIVER_CLASSES", 3)
    df = spark.range(50).select("id", (F.col("id") % 49).alias("y"))
    assert split.split_stratified(df, "id", "y", 0.2).where("split = 'test'").count() == 10
    assert sorted(r["count"] for r in split.kfold_stratified(df, "id", "y", 5).groupBy("fold").count().collect()) == [10] * 5


def test_many_classes(spark):
    """100,000 classes of three or four rows and a hot one: sizes of all parts are exact."""
    i = F.col("id")
    df = spark.range(450_000).where(i % 9 != 5).select("id", F.when(i < 400_000, i % 100_000).otherwise(-1).alias("y"))
    got = split.split_stratified(df, "id", "y", 0.25)
    sizes = got.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    row = sizes.agg(F.sum("t").alias("t"), F.count_if(F.abs(F.col("t") - 0.25 * F.col("n")) >= 1).alias("off"), F.count("*").alias("k")).first()
    assert tuple(row) == (-(-df.count() // 4), 0, 100_001)
