"""Profiling: numeric statistics, column profiles, sample values, class balance, reports.

All results are small tables keyed by column (one row per column of the input) or long
``(section, column_name, metric, value)`` tables; computing them is a handful of wide
aggregations over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    clean,
    hashable,
    is_categorical_type,
    is_datetime_type,
    is_missing,
    is_numeric_type,
    require_columns,
)
from ..functions.quantiles import ACCURACY, exact_quantiles, present, sketched
from ..session import cut_lineage
from ..sources.io import POSITION
from .quality import row_hashes

_STATS_SCHEMA = (
    "column_name string, position int, mean double, median double, std double, min double, max double"
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def _num(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    return clean(c, dt).cast("double")


def numeric_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per numeric column: mean, median, sample std, min, max, rounded to 2 decimals;
    missing cells skipped; an undefined value gives 0.0.

    One wide aggregation for mean/std/min/max and the sketch that brackets the median, which is
    an exact order statistic (:func:`lathe.functions.quantiles.exact_quantiles`) or, with
    ``exact=False``, the sketch's.
    """
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], _STATS_SCHEMA)
    row = df.agg(*_stats_aggs(df, cols, exact)).first()
    return _stats_table(df, cols, _stats_of(df, cols, row, exact))


def _stats_aggs(df: DataFrame, cols: list[str], exact: bool) -> list[Column]:
    aggs = []
    for i, c in enumerate(cols):
        x = _num(df, c)
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    xs = [present(df, c) for c in cols]
    return aggs + (sketched(xs, [0.5]) if exact else [F.percentile_approx(x, 0.5, ACCURACY).alias(f"med{i}") for i, x in enumerate(xs)])


def _stats_of(df: DataFrame, cols: list[str], row: Row, exact: bool) -> list[tuple]:
    """Mean, median, std, min, max of each column; 0.0 where undefined."""
    medians = exact_quantiles(df, cols, [0.5], row) if exact else {c: [row[f"med{i}"]] for i, c in enumerate(cols)}
    found = [(row[f"a{i}"], medians[c][0], row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)]
    return [tuple(0.0 if v is None or v != v else float(v) for v in values) for values in found]


def _stats_table(df: DataFrame, cols: list[str], stats: list[tuple]) -> DataFrame:
    out = df.sparkSession.createDataFrame([(c, df.columns.index(c), *values) for c, values in zip(cols, stats, strict=True)], _STATS_SCHEMA)
    return out.select("column_name", "position", *[F.round(c, 2).alias(c) for c in ("mean", "median", "std", "min", "max")])


def _cell(i: int, f: T.StructField) -> Column:
    """``position`` and two 64-bit hashes of a present cell; null for a missing one."""
    col = hashable(clean(f.name, f.dataType), f.dataType)
    return F.when(col.isNotNull(), F.struct(F.lit(i).alias("position"), F.xxhash64(col).alias("a"), F.xxhash64(F.lit("second"), col).alias("b")))


def profile_flags(df: DataFrame) -> list[tuple]:
    """Static part of the profile: ``(name, position, dtype, numeric, categorical, datetime)``."""
    out = []
    for i, f in enumerate(df.schema.fields):
        dt = f.dataType
        is_dt = is_datetime_type(dt)
        out.append((f.name, i, dt.simpleString(), is_numeric_type(dt), is_categorical_type(dt) and not is_dt, is_dt))
    return out


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: dtype, distinct non-missing values and their share, missing count and
    share (shares in percent, 2 decimals), and the numeric / categorical / datetime flags.

    ``exact=True``: distinct 128-bit hashes of the cells are counted per position, combined
    map-side, so long texts stay where they are and a column whose values are all distinct
    still spreads over all tasks. Different values are taken for equal if both 64-bit hashes
    agree: a chance below 10^-14 among 10^12 values. ``exact=False``: one pass of HyperLogLog
    sketches (``approx_count_distinct``).
    """
    spark = df.sparkSession
    flags = profile_flags(df)
    flag_df = spark.createDataFrame(
        flags, "column_name string, position int, dtype string, is_numeric boolean, is_categorical boolean, is_datetime boolean"
    )
    n_cols = len(df.columns)
    if exact:
        cells = F.explode(F.array_compact(F.array(*[_cell(i, f) for i, f in enumerate(df.schema.fields)])))
        long = df.select(cells.alias("_c")).select("_c.*").distinct()
        distinct = long.groupBy("position").agg(F.count("*").alias("unique_values"))
    else:
        row_aggs = [
            F.approx_count_distinct(clean(f.name, f.dataType), rsd=0.01).alias(f"d{i}") for i, f in enumerate(df.schema.fields)
        ]
        wide = df.agg(*row_aggs)
        pairs = ", ".join(f"{i}, d{i}" for i in range(n_cols))
        distinct = wide.selectExpr(f"stack({n_cols}, {pairs}) as (position, unique_values)")
    wide_missing = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)],
    )
    pairs = ", ".join(f"{i}, m{i}" for i in range(n_cols))
    missing = wide_missing.selectExpr("total_rows", f"stack({n_cols}, {pairs}) as (position, missing_count)")
    n = F.col("total_rows")
    return (
        F.broadcast(flag_df)
        .join(missing, "position")
        .join(distinct, "position", "left")
        .select(
            "column_name",
            F.col("position").cast("int").alias("position"),
            "dtype",
            F.coalesce(F.col("unique_values"), F.lit(0)).cast("long").alias("unique_values"),
            F.when(n > 0, F.round(F.coalesce(F.col("unique_values"), F.lit(0)) * 100.0 / n, 2)).otherwise(0.0).alias("unique_percentage"),
            F.col("missing_count").cast("long").alias("missing_count"),
            F.when(n > 0, F.round(F.col("missing_count") * 100.0 / n, 2)).otherwise(0.0).alias("missing_percentage"),
            "is_numeric",
            "is_categorical",
            "is_datetime",
        )
    )


def _sample_key(f: T.StructField) -> Column:
    """The column in a type of its own that ``min`` and ``>`` order: no value is rounded."""
    col = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double")) + F.lit(0.0)
    return col


def sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` distinct present values per column: the ``n`` smallest in the column's
    own type and order (Spark has no first-seen order). Columns ``column_name, position,
    rank, num_value, text_value``: numbers and booleans in ``num_value`` (as double), and
    all but floats and booleans exactly in ``text_value`` (dates as ISO text, timestamps to
    the microsecond).

    ``n`` passes of one wide aggregation each: pass ``k`` takes, per column, the minimum
    of the values above the value found in pass ``k-1``. Nothing is shuffled and no value
    is held beyond one running minimum per column, whatever the skew.
    """
    spark = df.sparkSession
    fields = [(i, f) for i, f in enumerate(df.schema.fields)
              if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]
    prev: dict = {}
    found: list = []
    for rank in range(1, n + 1):
        live = [(i, f) for i, f in fields if rank == 1 or prev.get(i) is not None]
        if not live:
            break
        aggs = []
        for i, f in live:
            key = _sample_key(f)
            low = F.min(key if rank == 1 else F.when(key > F.lit(prev[i]), key))
            aggs += [low.alias(f"v{i}"), _sample_text(low, f.dataType).alias(f"t{i}")]
        row = df.agg(*aggs).first()
        for i, f in live:
            v = prev[i] = row[f"v{i}"]
            if v is not None:
                number = isinstance(f.dataType, T.BooleanType) or is_numeric_type(f.dataType)
                found.append((f.name, i, rank, float(v) if number else None, row[f"t{i}"]))
    return spark.createDataFrame(found, "column_name string, position int, rank int, num_value double, text_value string")


def first_values(df: DataFrame, n: int = 5, position: tuple[str, ...] = POSITION, head: int = 10_000) -> DataFrame:
    """Up to ``n`` distinct present values per column in the order in which they first occur, by
    ``position`` (the columns that order the rows; a table read with its position has them).
    Columns as in :func:`sample_values`.

    The first ``head`` rows settle every column that shows ``n`` values there. Only the others
    are scanned whole, in passes of one wide ``min_by`` that each find the next value of every
    column; nothing but running minima is held, and no column is shuffled.
    """
    spark = df.sparkSession
    fields = {i: f for i, f in enumerate(f for f in df.schema.fields if f.name not in position)
              if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))}
    place = F.struct(*position)
    rows = df
    if position == POSITION:  # only the first file can hold the first rows
        start = df.agg(F.min(POSITION[0])).first()[0]
        rows = df.where(F.col(POSITION[0]) == F.lit(start))
    top = rows.orderBy(*position).limit(head)

    def cell(f: T.StructField) -> Column:
        key = _sample_key(f)
        number = isinstance(f.dataType, T.BooleanType) or is_numeric_type(f.dataType)
        return F.struct(key.cast("string").alias("k"), (key.cast("double") if number else F.lit(None).cast("double")).alias("num"), _sample_text(key, f.dataType).alias("text"))

    cells = F.array(*[F.struct(F.lit(i).alias("i"), cell(f).alias("c")) for i, f in fields.items()])
    seen = top.select(place.alias("p"), F.explode(cells).alias("_c")).select("p", "_c.i", "_c.c").where("c.k is not null") if fields else None
    found: dict[int, list] = {i: [] for i in fields}
    if seen is not None:
        firsts = seen.groupBy("i", "c").agg(F.min("p").alias("p"))
        rank = F.row_number().over(Window.partitionBy("i").orderBy("p"))
        for r in firsts.withColumn("rank", rank).where(F.col("rank") <= n).orderBy("i", "rank").collect():
            found[r.i].append(r.c)
    live = [i for i in fields if len(found[i]) < n]
    while live:
        aggs = []
        for i in live:
            c = cell(fields[i])
            new = c["k"].isNotNull() & ~c["k"].isin([v.k for v in found[i]]) if found[i] else c["k"].isNotNull()
            aggs.append(F.min_by(c, F.when(new, place)).alias(f"v{i}"))
        row = df.agg(*aggs).first()
        for i in live:
            if row[f"v{i}"] is not None:
                found[i].append(row[f"v{i}"])
        live = [i for i in live if row[f"v{i}"] is not None and len(found[i]) < n]
    out = [(fields[i].name, i, rank, v.num, v.text) for i, values in found.items() for rank, v in enumerate(values, 1)]
    return spark.createDataFrame(out, "column_name string, position int, rank int, num_value double, text_value string")


def _sample_text(value: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.FloatType, T.DoubleType, T.BooleanType)):
        return F.lit(None).cast("string")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return value.cast("string")


def class_balance(df: DataFrame, target: str, threshold: float = 20.0) -> DataFrame:
    """Distribution of the present target values: ``class_value, count, percentage,
    imbalanced``; imbalanced when any class share is strictly below ``threshold`` percent
    (a single class is not imbalanced). Errors: empty table, unknown column, no present
    target value.
    """
    check_balance_input(df, target)
    dt = df.schema[target].dataType
    counts = df.where(~is_missing(target, dt)).groupBy(F.col(target).alias("_cls")).count()
    tot = counts.agg(F.sum("count").alias("total"), F.min("count").alias("smallest")).first()
    total, smallest = tot["total"] or 0, tot["smallest"] or 0
    imbalanced = total > 0 and smallest * 100.0 / total < threshold
    return counts.select(
        F.col("_cls").cast("string").alias("class_value"),
        F.col("count").cast("long").alias("count"),
        F.round(F.col("count") * 100.0 / F.lit(total), 2).alias("percentage"),
        F.lit(imbalanced).alias("imbalanced"),
    )


def check_balance_input(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} does not exist")
    if df.isEmpty():
        raise ValueError("the table is empty")
    if df.where(~is_missing(target, df.schema[target].dataType)).isEmpty():
        raise ValueError(f"target column {target!r} has no present values")


def imbalance_flag(df: DataFrame, target: str, threshold: float = 20.0) -> DataFrame:
    """One row: ``imbalanced, n_classes, total``."""
    dt = df.schema[target].dataType
    counts = df.where(~is_missing(target, dt)).groupBy(target).count()
    tot = counts.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_classes"), F.min("count").alias("smallest"))
    return tot.select(
        (F.col("smallest") * 100.0 / F.col("total") < threshold).alias("imbalanced"),
        F.col("n_classes").cast("long"),
        F.col("total").cast("long"),
    )


_PROFILED = ["column_name", "position", "dtype", "unique_values", "unique_percentage", "missing_count", "missing_percentage", "is_numeric", "is_categorical", "is_datetime"]
_STATISTICS = ["mean", "median", "std", "min", "max"]


def _facts(df: DataFrame, exact: bool) -> tuple[DataFrame, int, int]:
    """The column profile with the statistics (null for other columns), rows and duplicate rows.

    One wide aggregation gives missing cells, moments and sketches, one count of hashes the
    distinct values of all columns and the distinct rows; the rest are the medians' proof and
    their few cells. What reaches the driver is a row for each column.
    """
    spark, fields = df.sparkSession, df.schema.fields
    cols = numeric_columns(df)
    missing = [F.count_if(is_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]
    sketches = [] if exact else [F.approx_count_distinct(clean(f.name, f.dataType), rsd=0.01).alias(f"d{i}") for i, f in enumerate(fields)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *missing, *sketches, *_stats_aggs(df, cols, exact)).first()
    whole = F.struct(F.lit(-1).alias("position"), *[h.alias(n) for n, h in zip("ab", row_hashes(df), strict=True)])
    cells = F.array(whole, *([_cell(i, f) for i, f in enumerate(fields)] if exact else []))
    hashes = df.select(F.explode(F.array_compact(cells)).alias("_c")).select("_c.*").distinct()
    found = {r["position"]: r["n"] for r in hashes.groupBy("position").agg(F.count("*").alias("n")).collect()}
    stats = dict(zip(cols, _stats_of(df, cols, row, exact), strict=True)) if cols else {}
    rows = [(*flags, found.get(i, 0) if exact else row[f"d{i}"], row[f"m{i}"], *stats.get(flags[0], (None,) * 5)) for i, flags in enumerate(profile_flags(df))]
    schema = ("column_name string, position int, dtype string, is_numeric boolean, is_categorical boolean, is_datetime boolean, unique_values long, missing_count long, "
              + ", ".join(f"{c} double" for c in _STATISTICS))
    n = row["rows"]
    share = {c: (F.round(F.col(v) * 100.0 / n, 2) if n else F.lit(0.0)).alias(c) for c, v in (("unique_percentage", "unique_values"), ("missing_percentage", "missing_count"))}
    table = spark.createDataFrame(rows, schema).select(*[share.get(c, c) for c in _PROFILED], *[F.round(c, 2).alias(c) for c in _STATISTICS])
    return table, n, n - found.get(-1, 0)


def analyze(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """The combined profile report as one long table ``(section, column_name, metric, value)``:
    missing, duplicates, numeric stats, column profile and, with a target, class balance.
    """
    if target is not None and target not in df.columns:
        raise ValueError(f"target column {target!r} does not exist")
    spark = df.sparkSession
    prof, n, extra = _facts(df, exact)
    if not n:
        raise ValueError("the table is empty")
    lines = "section string, column_name string, metric string, value double"
    repeats = spark.createDataFrame([("duplicates", None, "duplicate_rows", float(extra)), ("duplicates", None, "duplicate_percentage", extra * 100.0 / n)], lines)
    parts = [
        prof.where("missing_count > 0").selectExpr("'missing' as section", "column_name",
                                                   "stack(2, 'missing_count', cast(missing_count as double), 'missing_percentage', missing_percentage) as (metric, value)"),
        repeats.withColumn("value", F.round("value", 2)),
        prof.where("mean is not null").selectExpr("'statistics' as section", "column_name", "stack(5, 'mean', mean, 'median', median, 'std', std, 'min', min, 'max', max) as (metric, value)"),
        prof.selectExpr(
            "'profile' as section", "column_name",
            "stack(7, 'unique_values', cast(unique_values as double), 'unique_percentage', unique_percentage, "
            "'missing_count', cast(missing_count as double), 'missing_percentage', missing_percentage, "
            "'is_numeric', cast(is_numeric as double), 'is_categorical', cast(is_categorical as double), "
            "'is_datetime', cast(is_datetime as double)) as (metric, value)"),
    ]
    if target is not None:
        dt = df.schema[target].dataType
        # classes may be many: counted once, judged by one more row
        counts = cut_lineage(df.where(~is_missing(target, dt)).groupBy(F.col(f"`{target}`").cast("string").alias("class_value")).count())
        total = counts.agg(F.sum("count").alias("total"), F.min("count").alias("smallest")).first()
        if total["total"] is None:
            raise ValueError(f"target column {target!r} has no present values")
        flag = float(total["smallest"] * 100.0 / total["total"] < 20.0)
        parts.append(counts.withColumn("share", F.round(F.col("count") * 100.0 / F.lit(total["total"]), 2)).selectExpr(
            "'balance' as section", "class_value as column_name", "stack(2, 'count', cast(count as double), 'percentage', share) as (metric, value)"))
        parts.append(spark.createDataFrame([("balance", None, "imbalanced", flag)], lines))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p.toDF(*out.columns))
    return out


def dataset_context(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column in column order: the profile joined with the numeric statistics
    (left join by position; non-numeric columns get null statistics), plus the table's
    row count and duplicate rows. An error when the table has no columns.
    """
    if not df.columns:
        raise ValueError("the profile is empty: the table has no columns")
    prof, n, extra = _facts(df, exact)
    return prof.select("position", *[c for c in _PROFILED if c != "position"], *_STATISTICS, F.lit(n).cast("long").alias("n_rows"), F.lit(extra).cast("long").alias("duplicate_rows"))


__all__ = [
    "numeric_stats", "column_profile", "sample_values", "class_balance", "imbalance_flag", "analyze",
    "dataset_context", "check_balance_input", "numeric_columns", "require_columns",
]
