import datetime as dt

import pytest

from lathe.operators import problem


def _df(spark):
    rows = [(f"c{i % 3}", i % 2, i % 4, float(i), dt.datetime(2026, 1, 1) + dt.timedelta(days=i), i) for i in range(200)]
    return spark.createDataFrame(rows, "cat string, two int, low int, high double, when timestamp, row_id int")


def test_problem_type_rules(spark):
    df = _df(spark)
    got = {r["column_name"]: r["problem_type"] for r in problem.problem_type_by_column(df).collect()}
    assert got == {"cat": "classification", "two": "classification", "low": "classification",
                   "high": "regression", "when": None, "row_id": "regression"}


def test_resolve_problem(spark):
    df = _df(spark)
    p = problem.resolve_problem(df, "high")
    assert p.problem_type == "regression" and p.metric == "rmse"
    assert p.features == ("cat", "two", "low", "when", "row_id")
    p = problem.resolve_problem(df.drop("row_id", "when"))  # default target: the last column
    assert p.target == "high"
    assert problem.resolve_problem(df, "cat").metric == "f1"
    assert problem.resolve_problem(df, "high", problem_type="classification").problem_type == "classification"
    with pytest.raises(problem.ProblemError):
        problem.resolve_problem(df, "when")
    with pytest.raises(problem.ProblemError):
        problem.resolve_problem(df, "nope")
    with pytest.raises(problem.ProblemError):
        problem.resolve_problem(df, "high", excluded=["nope"])
    with pytest.raises(problem.ProblemError):
        problem.resolve_problem(df.select("cat", "high"), "high", excluded=["cat"])


def test_recommended_actions(spark):
    df = _df(spark)
    acts = {r["column_name"]: r for r in problem.recommend_actions(df, "high", ("logistic_regression",)).collect()}
    assert acts["row_id"]["action"] == "drop"  # ends with "id"
    assert acts["cat"]["action"] == "one_hot"
    assert acts["when"]["action"] == "datetime_extract"
    assert acts["low"]["action"] == "keep" and acts["low"]["scale"] == "standard"
    acts = {r["column_name"]: r for r in problem.recommend_actions(df, "high", ("random_forest",)).collect()}
    assert acts["low"]["scale"] is None
