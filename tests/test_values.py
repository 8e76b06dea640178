"""Values and names as users have them: missing tokens, mixed types, names, typed order."""

import pytest

from lathe.operators import evaluate, profile, quality
from lathe.sources import io


def test_csv_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e,f\n1,NA,x,true,2026-01-01,7\n2,2.5,null,false,2026-01-02,9999999999\nn/a,3,z,NaN,,8\n")
    df = io.read_table(spark, str(path))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string", "d": "boolean", "e": "date", "f": "bigint"}
    assert [tuple(r) for r in df.select("a", "b", "c", "d").collect()] == [(1, None, "x", True), (2, 2.5, None, False), (None, 3.0, "z", None)]
    typed = io.read_table(spark, str(path), schema="a long, b double, c string, d boolean, e date, f long")
    assert typed.where("b is null").count() == 1 and dict(typed.dtypes)["a"] == "bigint"


def test_merge_of_number_and_text(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(2.5, "t")], "x double, y string")
    out = io.merge_tables([a, b])
    assert dict(out.dtypes) == {"x": "double", "y": "string"}
    assert sorted(tuple(r) for r in out.collect()) == [(1.0, "2"), (2.5, "t")]


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "A")
    with pytest.raises(quality.RepeatedColumnsError):
        quality.validate(df)


def test_samples_are_not_rounded(spark):
    df = spark.sql("SELECT * FROM VALUES (9007199254740992L, timestamp'2026-01-01 00:00:00.1'), (9007199254740993L, timestamp'2026-01-01 00:00:00.2') t(n, ts)")
    got = [(r.column_name, r.text_value) for r in profile.sample_values(df).collect()]
    assert ("n", "9007199254740992") in got and ("n", "9007199254740993") in got
    assert ("ts", "2026-01-01T00:00:00.100000") in got and ("ts", "2026-01-01T00:00:00.200000") in got


def test_class_balance_needs_present_targets(spark):
    with pytest.raises(ValueError, match="empty"):
        profile.class_balance(spark.createDataFrame([], "t int"), "t")
    with pytest.raises(ValueError, match="present"):
        profile.class_balance(spark.createDataFrame([(None,)], "t int"), "t")


def test_positive_label_is_the_larger_number(spark):
    df = spark.createDataFrame([(9, 9, 0.1), (9, 10, 0.4), (10, 10, 0.9), (10, 10, 0.8)], "label int, prediction int, score double")
    row = evaluate.classification_metrics(df).first()
    assert (round(row.precision, 6), row.recall) == (0.666667, 1.0)
    assert evaluate.roc_auc(df).first()["roc_auc"] == 1.0


def test_auc_of_many_partitions(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2) if i % 10 else 0.5) for i in range(500)]
    got = evaluate.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()["roc_auc"]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(got - want) < 1e-9
