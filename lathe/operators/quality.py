"""Validation and cleaning: table checks, identical columns, duplicate rows, missing cells."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hashable, is_missing, require_columns


class ValidationError(ValueError):
    pass


class EmptyTableError(ValidationError):
    pass


class NoColumnsError(ValidationError):
    pass


class RepeatedColumnsError(ValidationError):
    pass


def repeated_names(df: DataFrame) -> list[str]:
    """Column names that occur more than once. Names that differ in case only are the same
    name unless ``spark.sql.caseSensitive`` is on, as Spark could not tell them apart."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    key = (lambda n: n) if exact else str.lower
    count = Counter(key(n) for n in df.columns)
    return sorted({n for n in df.columns if count[key(n)] > 1})


def validate(df: DataFrame) -> DataFrame:
    """Reject a table without columns, with repeated column names, or without rows."""
    if len(df.columns) == 0:
        raise NoColumnsError("the table has no columns")
    rep = repeated_names(df)
    if rep:
        raise RepeatedColumnsError(f"repeated column names: {rep}")
    if df.isEmpty():
        raise EmptyTableError("the table has no rows")
    return df


def validation_flags(df: DataFrame) -> DataFrame:
    """The three checks as one row: ``n_columns, is_empty, repeated_names``."""
    spark = df.sparkSession
    n_cols = len(df.columns)
    rep = len(repeated_names(df))
    empty = df.limit(1).groupBy().count().select((F.col("count") == 0).alias("is_empty"))
    return empty.select(
        F.lit(n_cols).cast("int").alias("n_columns"),
        "is_empty",
        F.lit(rep).cast("int").alias("repeated_names"),
        (F.lit(n_cols > 0 and rep == 0) & ~F.col("is_empty")).alias("valid"),
    )


def _fingerprints(df: DataFrame, cols: list[str]) -> dict:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.bit_xor(F.xxhash64(c)).alias(f"h{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"h{i}"]) for i, c in enumerate(cols)}


def identical_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs ``(later, earlier)`` where the later column equals an earlier one cell by cell
    (same type; NULL equals NULL and NaN equals NaN).

    Job 1 fingerprints every column in one aggregation (non-null count and an XOR of cell
    hashes); only columns with the same type and fingerprint are compared, in one
    ``bool_and(a <=> b)`` aggregation per round against the bucket's first column.
    """
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    if not cols:
        return []
    fp = _fingerprints(df, cols)
    buckets: dict = {}
    for c in cols:
        buckets.setdefault((df.schema[c].dataType.simpleString(), fp[c]), []).append(c)
    pending = [b for b in buckets.values() if len(b) > 1]
    pairs = []
    while pending:
        checks = [(b[0], other) for b in pending for other in b[1:]]
        row = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(o))).alias(f"e{i}") for i, (a, o) in enumerate(checks)]).first()
        equal = {checks[i] for i in range(len(checks)) if row[f"e{i}"] is not False}
        nxt = []
        for b in pending:
            rep, rest = b[0], b[1:]
            pairs += [(o, rep) for o in rest if (rep, o) in equal]
            left = [o for o in rest if (rep, o) not in equal]
            if len(left) > 1:
                nxt.append(left)
        pending = nxt
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted(pairs, key=lambda p: order[p[0]])


def identical_columns_report(df: DataFrame) -> DataFrame:
    pairs = identical_columns(df)
    schema = "column_name string, same_as string"
    return df.sparkSession.createDataFrame(pairs, schema)


def drop_identical_columns(df: DataFrame) -> DataFrame:
    """Drop every column whose whole content equals an earlier column; the first is kept."""
    drop = [later for later, _ in identical_columns(df)]
    return df.drop(*drop) if drop else df


def row_hashes(df: DataFrame, cols: list[str] | None = None) -> list[Column]:
    """The two 64-bit hashes ``_a``, ``_b`` by which :func:`duplicate_report` tells rows apart."""
    cols = list(cols or df.columns)
    require_columns(df, cols)
    bad = [c for c in cols if isinstance(df.schema[c].dataType, T.MapType)]
    if bad:
        raise ValueError(f"map columns cannot be compared for duplicates: {bad}")
    hin = [hashable(F.col(f"`{c}`"), df.schema[c].dataType) for c in cols]
    holes = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in cols])
    return [F.xxhash64(holes, *hin).alias("_a"), F.xxhash64(F.lit("second"), *reversed(hin), holes).alias("_b")]


def duplicate_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Repeats after the first occurrence over ``cols`` (all by default): one row with
    ``duplicate_rows, total_rows, duplicate_percentage``. An empty table gives 0.

    Rows are counted by a 128-bit hash of their values and of which cells are missing: only
    hashes cross the network, combined map-side, so long texts stay where they are and a row
    repeated in a third of the table is one partial count per task. Different rows are taken
    for equal if both 64-bit hashes agree: a chance below 10^-14 among 10^12 distinct rows.
    """
    by_hash = df.groupBy(*row_hashes(df, cols)).count()
    total, extra = F.coalesce(F.sum("count"), F.lit(0)).cast("long"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long")
    share = F.when(F.col("total_rows") > 0, F.round(F.col("duplicate_rows") * 100.0 / F.col("total_rows"), 2)).otherwise(0.0)
    return by_hash.agg(extra.alias("duplicate_rows"), total.alias("total_rows")).withColumn("duplicate_percentage", share)


def missing_counts(df: DataFrame) -> DataFrame:
    """One wide aggregation: ``total_rows`` and ``m{i}`` = missing cells of column i."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(is_missing(c, f.dataType)).alias(f"m{i}") for i, (c, f) in enumerate(zip(df.columns, df.schema.fields))],
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with any missing cell: ``column_name, position, missing_count, missing_percentage``.

    One wide aggregation, then ``stack`` of its single row into a long table.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, position int, missing_count bigint, missing_percentage double")
    wide = missing_counts(df)
    pairs = ", ".join(f"{i}, m{i}" for i in range(len(df.columns)))
    names = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("position") + 1)
    long = wide.selectExpr("total_rows", f"stack({len(df.columns)}, {pairs}) as (position, missing_count)")
    return long.where(F.col("missing_count") > 0).select(
        names.alias("column_name"),
        F.col("position").cast("int"),
        F.col("missing_count").cast("long"),
        F.round(F.col("missing_count") * 100.0 / F.col("total_rows"), 2).alias("missing_percentage"),
    )


def total_missing(df: DataFrame) -> int:
    row = missing_counts(df).first()
    return int(sum(row[f"m{i}"] for i in range(len(df.columns))))


def drop_missing_target(df: DataFrame, target: str, check: bool = True) -> DataFrame:
    """Rows whose target is present; an error when none remain."""
    require_columns(df, [target])
    out = df.where(~is_missing(target, df.schema[target].dataType))
    if check and out.isEmpty():
        raise ValueError(f"no rows with a present target {target!r}")
    return out
