import pytest
from pyspark.sql import functions as F

from lathe.operators import quality


def test_validate_errors(spark):
    with pytest.raises(quality.NoColumnsError):
        quality.validate(spark.range(1).select())
    rep = spark.createDataFrame([(1, 2)], "value int, v2 int").toDF("value", "value")
    with pytest.raises(quality.RepeatedColumnsError):
        quality.validate(rep)
    with pytest.raises(quality.EmptyTableError):
        quality.validate(spark.createDataFrame([], "a int"))


def test_duplicates_fixture(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (3, "c"), (2, "b")], "A bigint, B string")
    r = quality.duplicate_report(df).first()
    assert r["duplicate_rows"] == 2 and r["duplicate_percentage"] == 40.0
    empty = quality.duplicate_report(spark.createDataFrame([], "A bigint")).first()
    assert empty["duplicate_rows"] == 0 and empty["duplicate_percentage"] == 0.0


def test_duplicates_nan_equal(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (None,), (None,)], "x double")
    assert quality.duplicate_report(df).first()["duplicate_rows"] == 2


def test_missing_fixture(spark):
    df = spark.createDataFrame(
        [(1.0, "a", 1.0), (2.0, "b", 2.0), (None, "c", 3.0), (4.0, None, 4.0), (5.0, "e", 5.0)], "A double, B string, C double")
    rows = {r["column_name"]: r for r in quality.missing_report(df).collect()}
    assert set(rows) == {"A", "B"}
    assert rows["A"]["missing_count"] == 1 and rows["A"]["missing_percentage"] == 20.0
    assert quality.total_missing(df) == 2


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert quality.total_missing(df) == 1


def test_identical_columns(spark):
    df = spark.createDataFrame([(1, 1, 2, float("nan"), float("nan")), (2, 2, 1, 1.0, 1.0), (None, None, 3, None, None)],
                               "a int, b int, c int, d double, e double")
    assert quality.identical_columns(df) == [("b", "a"), ("e", "d")]
    assert quality.drop_identical_columns(df).columns == ["a", "c", "d"]


def test_identical_columns_same_fingerprint_different_order(spark):
    # equal multisets of values cancel in the fingerprint; the exact check keeps them apart
    df = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert quality.identical_columns(df) == []


def test_drop_missing_target(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "k int, y double")
    assert quality.drop_missing_target(df, "y").count() == 1
    with pytest.raises(ValueError):
        quality.drop_missing_target(df.where(F.col("y").isNull()), "y")


def test_duplicates_tell_missing_cells_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None), (None, None)], "a string, b string")
    assert quality.duplicate_report(df).first()["duplicate_rows"] == 1
    assert quality.duplicate_report(df.limit(0)).first()["duplicate_percentage"] == 0.0


def test_nested_values_are_compared_whole(spark):
    """A missing element or field tells rows apart."""
    rows = [(1, [1, None], ("a", None)), (1, [1], ("a", None)), (1, [None, 1], (None, "a")), (1, [1], ("a", None)), (1, None, None)]
    df = spark.createDataFrame(rows, "x int, a array<int>, s struct<p:string,q:string>")
    assert quality.duplicate_report(df).first()["duplicate_rows"] == 1
