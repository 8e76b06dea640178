import math

import pytest

from lathe.operators import prep


def _fixture(spark):
    return spark.createDataFrame([(20.0, 50000.0, "sales"), (None, 60000.0, None), (30.0, None, "engineering")],
                                 "age double, salary double, department string")


def test_chain_fixture(spark):
    df = _fixture(spark)
    steps = [prep.Impute(["age", "salary"], "s1", "median"), prep.Impute(["department"], "s2", "mode"),
             prep.OneHot(["department"], "s3"), prep.Scale(["age"], "s4", "standard"),
             prep.Scale(["salary"], "s5", "robust"), prep.Passthrough(["salary"], "s6")]
    out = prep.PrepPipeline(steps).fit(df).transform(df)
    assert {"department_sales", "department_engineering", "age", "salary"} <= set(out.columns)
    rows = out.collect()
    assert all(v is not None for r in rows for v in r)
    # mode ties go to the smallest value: 'engineering'
    assert sorted(r["department_engineering"] for r in rows) == [0.0, 1.0, 1.0]


def test_impute_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "b"), (10.0, None)], "x double, c string")
    mean = prep.PrepPipeline([prep.Impute(["x"], strategy="mean")]).fit(df).transform(df)
    assert [r["x"] for r in mean.collect()][2] == pytest.approx(13 / 3)
    med = prep.PrepPipeline([prep.Impute(["x"], strategy="median")]).fit(df).transform(df)
    assert [r["x"] for r in med.collect()][2] == 2.0
    mode = prep.PrepPipeline([prep.Impute(["c"], strategy="mode")]).fit(df).transform(df)
    assert [r["c"] for r in mode.collect()][3] == "b"
    const = prep.PrepPipeline([prep.Impute(["x"], strategy="constant", fill_value=0)]).fit(df).transform(df)
    assert [r["x"] for r in const.collect()][2] == 0.0


def test_encoders_unseen_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    oh = prep.PrepPipeline([prep.OneHot(["c"])]).fit(train).transform(test)
    assert oh.columns == ["c_a", "c_b", "c_nan"]
    assert [tuple(r) for r in oh.collect()] == [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]
    od = prep.PrepPipeline([prep.Ordinal(["c"])]).fit(train).transform(test)
    assert [r["c"] for r in od.collect()] == [0.0, -1.0, None]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, k double")
    st = prep.PrepPipeline([prep.Scale(["x", "k"], method="standard")]).fit(df).transform(df).collect()
    sd = math.sqrt(1.25)
    assert [r["x"] for r in st] == pytest.approx([(v - 2.5) / sd for v in (1, 2, 3, 4)])
    assert [r["k"] for r in st] == [0.0] * 4  # zero std divides by 1
    mm = prep.PrepPipeline([prep.Scale(["x", "k"], method="minmax")]).fit(df).transform(df).collect()
    assert [r["x"] for r in mm] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert [r["k"] for r in mm] == [0.0] * 4  # zero range gives 0
    rb = prep.PrepPipeline([prep.Scale(["x"], method="robust")]).fit(df).transform(df).collect()
    assert [r["x"] for r in rb] == pytest.approx([(v - 2.5) / 1.5 for v in (1, 2, 3, 4)])


def test_argument_checks(spark):
    df = _fixture(spark)
    with pytest.raises(prep.PrepError):
        prep.PrepPipeline([prep.Impute(["age"], "a", "mean"), prep.Impute(["age"], "b", "median")])
    with pytest.raises(prep.PrepError):
        prep.PrepPipeline([prep.Impute(["age"], "a"), prep.Drop(["salary"], "a")])
    with pytest.raises(prep.PrepError):
        prep.PrepPipeline([prep.Scale(["age"])], target="age")
    with pytest.raises(prep.PrepError):
        prep.PrepPipeline([prep.Scale(["department"])]).fit(df)
    with pytest.raises(prep.PrepError):
        prep.PrepPipeline([prep.OneHot(["nope"])]).fit(df)


def test_dropped_columns_skipped_and_json_roundtrip(spark, tmp_path):
    df = _fixture(spark)
    model = prep.PrepPipeline([prep.Drop(["age"]), prep.Scale(["age", "salary"], method="minmax")]).fit(df)
    out = model.transform(df)
    assert "age" not in out.columns
    again = prep.PrepModel.from_json(model.to_json()).transform(df)
    assert out.collect() == again.collect()


def test_datetime_parts(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2026, 3, 4, 5, 6),)], "t timestamp")
    out = prep.PrepPipeline([prep.DatetimeParts(["t"])]).fit(df).transform(df).first()
    assert (out["t_year"], out["t_month"], out["t_day"], out["t_hour"]) == (2026, 3, 4, 5)


def test_prep_on_stream(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    model = prep.PrepPipeline([prep.Scale(["x"], method="minmax")]).fit(df)
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema("x double").parquet(path)
    q = model.transform(stream).writeStream.format("memory").queryName("prep_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["x"] for r in spark.sql("SELECT * FROM prep_stream").collect()) == [0.0, 1.0]
