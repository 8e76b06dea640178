"""Encodings whose categories are tables: equal to the short form, hot, missing and unseen values."""

import pytest
from pyspark.sql import functions as F

from lathe.functions import ranking
from lathe.operators import prep


@pytest.fixture(scope="module")
def table(spark):
    """200,000 categories; a third of the rows share one, some are missing."""
    i = F.col("id")
    value = F.when(i % 3 == 0, "hot").when(i % 10 == 1, None).otherwise(F.concat(F.lit("v"), i))
    return spark.range(0, 375_000).select("id", value.alias("c"), (i % 7 == 0).alias("b"), F.concat(F.lit("s"), i % 4).alias("s"))


def codes(values):
    return {v: n for n, v in enumerate(sorted({v for v in values if v is not None}))}


def test_numbered_is_the_global_order(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("x"), (F.col("id") % 3).alias("g"))
    got = ranking.numbered(df.repartition(7), ["x"]).collect()
    assert all(r.x == r.number for r in got) and len(got) == 5000
    seen = {}
    for r in sorted(ranking.numbered(df, ["x"], "n", "g").collect(), key=lambda r: (r.g, r.x)):
        assert r.n == seen.get(r.g, 0)
        seen[r.g] = r.n + 1
    assert ranking.numbered(df.where("false"), ["x"]).count() == 0


@pytest.mark.parametrize("partitions", [None, 3000])
def test_running_sums(spark, partitions):
    """One group of nearly all rows and small ones (missing is a group), over many partitions."""
    df = spark.range(6000).select(F.when(F.col("id") % 100 != 0, 1).when(F.col("id") % 200 == 0, 2).alias("g"), ((F.col("id") * 7919) % 6007).alias("x"), (F.col("id") % 5).alias("n"))
    for upto in (-1, 0):
        seen = {}
        for r in sorted(ranking.running_sums(df, "g", "x", {"n": "s"}, upto, partitions).collect(), key=lambda r: (r.g is None, r.g, r.x)):
            before = seen.get(r.g, 0)
            seen[r.g] = before + r.n
            assert r.s == (before if upto else seen[r.g])
        assert len(seen) == 3


def test_wide_ordinal_and_one_hot(spark, table):
    train = table.where("id < 300000")
    want = codes(r.c for r in train.select("c").distinct().collect())
    assert len(want) > 180_000
    steps = [prep.Ordinal(["c"])]
    got = prep.PrepPipeline(steps).fit(train).transform(table)
    assert got.columns == ["c", "id", "b", "s"]
    rows = got.join(table.select("id", F.col("c").alias("v")), "id").select("v", "c").distinct().collect()
    assert all(r.c is None if r.v is None else r.c == want.get(r.v, -1) for r in rows) and got.count() == table.count()

    got = prep.PrepPipeline([prep.OneHot(["s", "c", "b"])]).fit(train).transform(table)
    assert got.columns == ["s_s0", "s_s1", "s_s2", "s_s3", "c_onehot", "b_false", "b_true", "id"]
    vec = F.unwrap_udt("c_onehot")
    rows = got.select("id", vec["size"].alias("size"), vec["indices"].alias("at")).join(table.select("id", F.col("c").alias("v")), "id")
    assert rows.count() == table.count()
    place = want | {None: len(want)}
    for r in rows.select("size", "at", "v").distinct().collect():
        assert r.size == len(want) + 1 and r.at == ([place[r.v]] if r.v in place else [])


@pytest.mark.parametrize("missing", [True, False])
def test_vector_places_are_the_columns(spark, missing):
    values = ["b", "a", "c", "b"] + ([None] if missing else [])
    train = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    other = spark.createDataFrame([(0, "a"), (1, "zz"), (2, None), (3, "c")], "id int, c string")
    wide = prep.PrepPipeline([prep.OneHot(["c"], output="columns")]).fit(train).transform(other).orderBy("id").collect()
    vec = prep.PrepPipeline([prep.OneHot(["c"], output="vector")]).fit(train).transform(other).orderBy("id").collect()
    assert [list(r.c_onehot.toArray()) for r in vec] == [[r[k] for k in r.asDict() if k != "id"] for r in wide]
    with pytest.raises(prep.PrepError):
        prep.PrepPipeline([prep.OneHot(["c"], output="wide")]).fit(train)


def test_order_of_the_column_s_own_type_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 1)
    train = spark.createDataFrame([(i, str(i % 12), i % 2 == 0) for i in range(40)], "id int, t string, b boolean")
    got = prep.PrepPipeline([prep.Ordinal(["t", "b"])]).fit(train).transform(train).orderBy("id").collect()
    order = codes(str(i) for i in range(12))
    assert [(r.t, r.b) for r in got] == [(order[str(i % 12)], float(i % 2 == 0)) for i in range(40)]
    none = prep.PrepPipeline([prep.OneHot(["t"]), prep.Ordinal(["b"])]).fit(train.where("false")).transform(train)
    assert none.columns == ["b", "id"] and {r.b for r in none.collect()} == {-1.0}


def test_save_and_load(spark, table, tmp_path):
    model = prep.PrepPipeline([prep.Ordinal(["c"]), prep.Drop(["s"])]).fit(table)
    model.save(spark, str(tmp_path / "prep"))
    again = prep.PrepModel.load(spark, str(tmp_path / "prep"))
    small = table.where("id < 2000")
    assert sorted(map(str, again.transform(small).collect())) == sorted(map(str, model.transform(small).collect()))
    with pytest.raises(prep.PrepError, match="tables"):
        prep.PrepModel.from_json(model.to_json())


def test_hot_rows_are_spread(spark, table):
    """Neither a third of the rows nor the missing ones meet the table under one key."""
    keyed = ranking.looked_up(table, F.col("c"), table.limit(0).select(F.col("c").alias("value"), F.col("id").alias("code")),
                              spark.createDataFrame([("hot", 5)], "value string, code long"), "code")
    assert keyed.where("c = 'hot' and code = 5").count() == table.where("c = 'hot'").count()
    plan = keyed._jdf.queryExecution().analyzed().toString()
    assert "_lk_spread" in plan and "xxhash64" in plan
