import datetime as dt
import math
import uuid

import pytest

from lathe.operators import engineer as fe


def _run(spark, rows, schema, steps):
    df = spark.createDataFrame(rows, schema)
    out, lineage = fe.engineer(df, steps)
    return out.collect(), lineage


def test_ratio_difference_square(spark):
    rows, _ = _run(spark, [(10.0, 2.0, 1), (20.0, 0.0, 0), (30.0, -1.0, 1)], "A double, B double, target int",
                   [fe.Ratio("A", "B", "r")])
    assert [r["r"] for r in rows] == [5.0, None, -30.0]
    rows, _ = _run(spark, [(10.0, 2.0), (5.0, 8.0)], "A double, B double", [fe.Difference("A", "B", "d")])
    assert [r["d"] for r in rows] == [8.0, -3.0]
    rows, _ = _run(spark, [(2.0,), (3.0,), (4.0,)], "A double", [fe.Square("A", "s")])
    assert [r["s"] for r in rows] == [4.0, 9.0, 16.0]


def test_log1p(spark):
    rows, _ = _run(spark, [(0.0,), (1.0,), (-1.0,)], "A double", [fe.Log1p("A", "l")])
    assert [r["l"] for r in rows][:2] == [0.0, pytest.approx(math.log(2))]
    assert rows[2]["l"] == float("-inf")
    with pytest.raises(Exception, match="log1p input 'A' has values below -1"):
        _run(spark, [(-1.01,)], "A double", [fe.Log1p("A", "l")])
    with pytest.raises(Exception, match="square input 'A' has missing values"):
        _run(spark, [(None,), (1.0,)], "A double", [fe.Square("A", "s")])


def test_checks_start_no_job(spark):
    """Ten log steps and a square: the one job is that of the action."""
    df = spark.createDataFrame([(2.0**i,) for i in range(50)], "A double")
    tracker, group = spark.sparkContext.statusTracker(), f"engineer-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "engineer")
    try:
        out, _ = fe.engineer(df, [fe.Log1p("A" if i == 0 else f"l{i - 1}", f"l{i}") for i in range(10)] + [fe.Square("l9", "s")])
        assert not tracker.getJobIdsForGroup(group)
        assert out.count() == 50
        assert tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_datetime_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 13, 5), 1.0), (None, 2.0)], "t timestamp, x double")
    out, lineage = fe.engineer(df, [fe.DatetimeParts("t", "at", "s1"), fe.Interaction("at_hour", "x", "hx")])
    rows = out.orderBy("x").collect()
    assert out.columns == ["t", "x", "at_year", "at_month", "at_day", "at_dayofweek", "at_hour", "hx"]
    assert tuple(rows[0])[2:] == (2024, 2, 29, 5, 13, 13.0) and tuple(rows[1])[2:] == (None,) * 6
    assert [x["output"] for x in lineage] == [f"at_{p}" for p in ("year", "month", "day", "dayofweek", "hour")] + ["hx"]
    for bad in ([fe.DatetimeParts("x", "p")], [fe.DatetimeParts("t", "p"), fe.Square("x", "p_day")]):
        with pytest.raises(fe.EngineeringError):
            fe.engineer(df, bad)
    with pytest.raises(fe.EngineeringError):
        fe.engineer(df, [fe.DatetimeParts("t", "y")], target="y_day")
    _, lineage = fe.engineer(df.drop("t"), [fe.DatetimeParts("t", "at")], raw_columns=["t"])
    assert {x["status"] for x in lineage} == {"skipped"}


def test_chain_and_rules(spark):
    rows, lineage = _run(spark, [(2.0, 5.0), (3.0, 10.0)], "A double, B double",
                         [fe.Interaction("A", "B", "ab"), fe.Ratio("ab", "A", "back")])
    assert [r["back"] for r in rows] == [5.0, 10.0]
    assert [x["status"] for x in lineage] == ["applied", "applied"]
    df = spark.createDataFrame([(1.0, 2.0)], "A double, B double")
    with pytest.raises(fe.EngineeringError):
        fe.engineer(df, [fe.Feature("custom", ("A",), "c")])
    with pytest.raises(fe.EngineeringError):
        fe.engineer(df, [fe.Square("nope", "c")])
    with pytest.raises(fe.EngineeringError):
        fe.engineer(df, [fe.Square("A", "B")])
    with pytest.raises(fe.EngineeringError):
        fe.engineer(df, [fe.Square("A", "y")], target="A")
    out, lineage = fe.engineer(df.drop("B"), [fe.Square("B", "c")], raw_columns=["A", "B"])
    assert lineage[0]["status"] == "skipped" and "c" not in out.columns
