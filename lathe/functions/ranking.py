"""Consecutive numbers in a global order, and joins with dictionaries of any size.

A number of each row in a total order needs no window without partitions: rows are range
partitioned and sorted, each partition numbers its own, and the sizes of the partitions before
it are added. The partitioned rows are written first, so that numbers and sizes are of the same
partitions whatever happens to executors later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A value in at least this share of the rows is hot; so there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.001
#: Tasks over which the rows of hot or missing values are dealt.
SPREAD = 4096


def _placed(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in range partitions of ``keys``, each sorted, with ``_part``; written once."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return cut_lineage(ranged.sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def _joined(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Equal keys (missing ones are equal, too); ``small`` adds its other columns."""
    named = small.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [df[k].eqNullSafe(named[f"_key_{k}"]) for k in keys]
    return df.join(named, same).drop(*[f"_key_{k}" for k in keys])


def numbered(df: DataFrame, order: list[str], name: str = "number", group: str | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``, afresh in each ``group``. ``order`` must be
    total for the numbers to be fixed; rows of one partition only are sorted by one task."""
    own = ["_part", group] if group else ["_part"]
    placed = _placed(df, [group, *order] if group else list(order))
    sizes = placed.groupBy(*own).agg(F.count("*").alias("_n"), F.min("_at").alias("_start"))
    # as many rows as partitions and groups; with a group, each group's partitions
    earlier = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*own, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"))
    return _joined(placed, starts, own).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def running_sums(df: DataFrame, group: str, order: str, sums: dict[str, str], upto: int, partitions: int | None = None) -> DataFrame:
    """``df`` with running sums (column -> name) within each ``group`` in ``order``, up to the row
    before (-1) or the row itself (0): totals of the range partitions before, and a window inside
    each partition. A window task holds a partition, however large the group."""
    placed = _placed(df, [group, order], partitions).drop("_at")
    own = ["_part", group]
    totals = placed.groupBy(*own).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*own, *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    return _joined(placed, offsets, own).select(*df.columns, *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(out) for c, out in sums.items()])


def looked_up(df: DataFrame, value: Column, codes: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: the code of ``value`` (null if it has none).

    ``codes`` and ``hot`` (at most ``1 / HOT_SHARE`` rows, broadcast) are tables of ``value`` and
    ``code``. Rows of a hot value take their code from ``hot`` and, like rows without a value,
    go to the join with ``codes`` under many keys, so no task gets them all. Spark broadcasts
    ``codes`` where its size allows."""
    known = F.broadcast(hot.select(F.col("value").alias("_lk_hot"), F.col("code").alias("_lk_hot_code")))
    rows = df.withColumn("_lk_value", value).join(known, F.col("_lk_value") == F.col("_lk_hot"), "left").drop("_lk_hot")
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    spread = F.when(F.col("_lk_value").isNull() | F.col("_lk_hot_code").isNotNull(), 1 + F.pmod(row, F.lit(SPREAD))).otherwise(0)
    rows = rows.withColumns({"_lk_spread": spread.cast("int"), "_lk_value": F.coalesce("_lk_value", F.lit(""))})
    table = codes.select(F.col("value").alias("_lk_value"), F.lit(0).alias("_lk_spread"), F.col("code").alias("_lk_code"))
    joined = rows.join(table, ["_lk_value", "_lk_spread"], "left")
    return joined.withColumn(name, F.coalesce("_lk_hot_code", "_lk_code")).drop("_lk_value", "_lk_spread", "_lk_hot_code", "_lk_code")
