"""Shared tables and batch bounds."""

from lathe.llm import scratch
from lathe.llm.components import components

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_but_never_raised(spark):
    before = spark.conf.get(KEY)
    try:
        for given, kept in (("64m", scratch.BATCH_BYTES), ("1m", 1 << 20), ("5000000b", 5_000_000)):
            spark.conf.set(KEY, given)
            scratch.small_batches(spark)
            number = spark.conf.get(KEY).lower().rstrip("b")
            assert int(number.rstrip("m")) * (1 << 20 if number.endswith("m") else 1) == kept
    finally:
        spark.conf.set(KEY, before)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 20), (5, 5), (30, 1), (1, 30)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {n: got.get(n, n) for n in (1, 2, 3, 30, 7, 8, 9, 20, 5)} == {1: 1, 2: 1, 3: 1, 30: 1, 7: 7, 8: 7, 9: 7, 20: 7, 5: 5}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
