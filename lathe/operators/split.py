"""Reproducible splits and folds: random, stratified, time, k-fold, stratified k-fold.

Spark has no row order, so every split names a unique ``key``. Random orders are a
seeded hash of the key (:func:`lathe.functions.ordering.hash_order`), ties broken by the
key itself. Exact split sizes come from cut points: the row at rank ``r`` in
``(order value, key)`` order is found by :func:`lathe.functions.ordering.lexi_cutoffs`
(a few aggregation jobs, never a global sort), and a row's split is then a comparison
with the cut point — a projection with no shuffle of the table itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_datetime_type, require_columns
from ..functions.ordering import before, hash_order, lexi_cutoffs, small_table
from ..functions.ranking import HOT_SHARE, looked_up, numbered, running_sums
from ..session import cut_lineage

TRAIN, TEST = "train", "test"


def _check_share(t: float) -> None:
    if not 0.0 < t < 1.0:
        raise ValueError(f"test share must be in (0, 1), got {t}")


def _cut_column(a: Column, b: Column, cuts: list[tuple]) -> Column:
    """Number of cut points at or before row ``(a, b)``."""
    terms = [F.when(before(a, b, c), 0).otherwise(1) for c in cuts]
    out = F.lit(0)
    for t in terms:
        out = out + t
    return out


def number_rows(df: DataFrame, col: str = "_row_key") -> DataFrame:
    """Give every row a number of its own, equal rows included, for tables without a key. The
    numbers follow the order of reading and are fixed by a checkpoint."""
    return cut_lineage(df.withColumn(col, F.monotonically_increasing_id()))


def split_random(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, exact: bool = True,
                 col: str = "split") -> DataFrame:
    """Seeded random split: the ``ceil(test_size * n)`` rows first in hash order are test.

    ``exact=False`` skips the count and the cut point: a row is test when its hash falls
    below ``test_size`` of the hash range (no job at all; sizes are right in expectation).
    """
    _check_share(test_size)
    require_columns(df, [key])
    h = hash_order(key, seed)
    if not exact:
        return df.withColumn(col, F.when(h < F.lit(int(test_size * (1 << 60))), TEST).otherwise(TRAIN))
    n = df.count()
    n_test = math.ceil(test_size * n)
    if n_test >= n:
        raise ValueError(f"a test share of {test_size} leaves no training rows out of {n}")
    if n_test == 0:
        return df.withColumn(col, F.lit(TRAIN))
    ordered = df.select(h.alias("_h"), F.col(key).alias("_k"))
    (cut,) = lexi_cutoffs(ordered, ("_h", "_k"), [(0, n_test)], counts={0: n})
    return df.withColumn(col, F.when(before(h, F.col(key), cut), TEST).otherwise(TRAIN))


#: Classes whose counts and cut points the driver keeps; more are tables, with the same result.
DRIVER_CLASSES = 1_000


def _class_counts(df: DataFrame, target: str) -> dict | None:
    """Rows per class; None if there are more than ``DRIVER_CLASSES``."""
    rows = df.groupBy(target).count().limit(DRIVER_CLASSES + 1).collect()
    if len(rows) > DRIVER_CLASSES:
        return None
    counts = {r[0]: r[1] for r in rows}
    if None in counts:
        raise ValueError(f"target {target!r} has missing values; drop them first")
    return counts


def _class_table(df: DataFrame, target: str) -> tuple[DataFrame, int, int, int]:
    """A table ``cls, n`` of the classes, and the number of rows, of classes, and of rows of the
    smallest class."""
    table = cut_lineage(df.groupBy(F.col(f"`{target}`").alias("cls")).agg(F.count("*").alias("n")))
    row = table.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("n").alias("least"), F.count_if(F.col("cls").isNull()).alias("missing")).first()
    if row["missing"]:
        raise ValueError(f"target {target!r} has missing values; drop them first")
    return table, row["n"], row["k"], row["least"]


def _quota_table(classes: DataFrame, n: int, n_test: int) -> DataFrame:
    """:func:`stratified_quotas` of a table of classes: ``cls, n, quota``."""
    share = F.col("n").cast("decimal(19,0)") * F.lit(n_test).cast("decimal(19,0)")
    rows = classes.withColumns({"base": F.expr(f"cast(n as decimal(19,0)) * cast({n_test} as decimal(19,0)) div {n}").cast("long"), "rest": -(share % F.lit(n).cast("decimal(19,0)"))})
    placed = numbered(rows, ["rest", "cls"], "place")
    extra = n_test - (placed.agg(F.sum("base")).first()[0] or 0)
    return placed.select("cls", "n", (F.col("base") + F.when(F.col("place") < extra, 1).otherwise(0)).alias("quota"))


def _fold_table(classes: DataFrame, k: int) -> DataFrame:
    """:func:`stratified_fold_sizes` of a table of classes: ``cls, n, bounds`` (rows before each
    fold but the first)."""
    rows = classes.withColumns({"g": F.lit(0), "q": F.expr(f"n div {k}"), "e": F.col("n") % k})
    start = F.col("given") % k
    placed = running_sums(rows, "g", "cls", {"e": "given"}, -1)

    def bound(j: int) -> Column:
        extra = F.filter(F.sequence(F.lit(0), F.lit(j - 1)), lambda f: F.pmod(f - start, F.lit(k)) < F.col("e"))
        return j * F.col("q") + F.size(extra)

    return placed.select("cls", "n", F.array(*[bound(j) for j in range(1, k)]).alias("bounds"))


def _cut_by_table(df: DataFrame, target: str, h: Column, key: str, wanted: DataFrame, n: int, col: str, label) -> DataFrame:
    """Cut every class at its ``bounds`` (rows before a cut), all per-class state in tables.

    Rows (order, key and class only) are numbered within their class, the rows at the bounds are
    the cut points, and each row of ``df`` is compared with those of its class. Classes that
    hold many rows are looked up in a broadcast part of the table, so none is one join key.
    """
    text = F.col(f"`{target}`").cast("string")

    def coded(table: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
        codes = table.select(F.col("cls").cast("string").alias("value"), F.col(code).alias("code"), "n")
        return codes.drop("n"), codes.where(F.col("n") >= max(2.0, HOT_SHARE * n)).drop("n")

    narrow = df.select(F.col(f"`{target}`").alias("_cls"), h.alias("a"), F.col(f"`{key}`").alias("b"))
    placed = numbered(narrow, ["a", "b"], "_n", "_cls")
    at = looked_up(placed, F.col("_cls").cast("string"), *coded(wanted, "bounds"), "_bounds").where(F.array_contains("_bounds", F.col("_n")))
    cuts = at.groupBy("_cls").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))  # at most as many as bounds
    # a bound at the class's end has no row to cut at: no row lies behind it; one at 0 cuts at the first
    table = wanted.join(cuts, wanted["cls"] == cuts["_cls"], "left").select("cls", "n", F.col("cuts").alias("code"))
    codes, hot = coded(cut_lineage(table), "code")
    found = looked_up(df.withColumn("_h", h), text, codes, hot, "_code")
    before_it = F.coalesce(F.array_size(F.filter("_code", lambda c: (c["a"] < F.col("_h")) | ((c["a"] == F.col("_h")) & (c["b"] <= F.col(f"`{key}`"))))), F.lit(0))
    return found.withColumn(col, label(before_it)).drop("_h", "_code")


def stratified_quotas(counts: dict, n_test: int) -> dict:
    """Test rows per class: ``floor(n_c * T / n)`` plus one for the classes with the
    largest remainders (ties: smaller class value) so that the quotas sum to ``T``."""
    n = sum(counts.values())
    base = {c: (k * n_test) // n for c, k in counts.items()}
    rem = n_test - sum(base.values())
    order = sorted(counts, key=lambda c: (-((counts[c] * n_test) % n), c))
    for c in order[:rem]:
        base[c] += 1
    return base


def _apply_group_cuts(df: DataFrame, target: str, h: Column, key: str, cuts: dict, col: str, label) -> DataFrame:
    """Join the per-class cut table (broadcast up to ``MAX_TARGETS`` classes) and compare each row."""
    spark = df.sparkSession
    ttype = df.schema[target].dataType
    htype, ktype = T.LongType(), df.schema[key].dataType
    schema = T.StructType([
        T.StructField("_cls", ttype),
        T.StructField("_cuts", T.ArrayType(T.StructType([T.StructField("a", htype), T.StructField("b", ktype)]))),
        T.StructField("_fixed", T.IntegerType()),
    ])
    rows = [(c, [tuple(x) for x in v[0]], v[1]) for c, v in cuts.items()]
    table = small_table(spark.createDataFrame(rows, schema), len(rows))
    joined = df.withColumn("_h", h).join(table, df[target].eqNullSafe(table["_cls"]))
    n_before = F.size(F.filter("_cuts", lambda c: (c["a"] < F.col("_h")) | ((c["a"] == F.col("_h")) & (c["b"] <= F.col(key)))))
    idx = F.coalesce(F.col("_fixed"), n_before)
    return joined.withColumn(col, label(idx)).drop("_h", "_cls", "_cuts", "_fixed")


def split_stratified(df: DataFrame, key: str, target: str, test_size: float = 0.2, seed: int = 42,
                     col: str = "split") -> DataFrame:
    """Stratified split on the target: every class gives its quota of test rows (the first
    in hash order within the class). Falls back to :func:`split_random` when a class has
    fewer than two rows."""
    _check_share(test_size)
    require_columns(df, [key, target])
    counts = _class_counts(df, target)
    h = hash_order(key, seed)
    if counts is None:
        classes, n, _, least = _class_table(df, target)
        if least < 2:
            return split_random(df, key, test_size, seed, col=col)
        n_test = math.ceil(test_size * n)
        if n_test >= n:
            raise ValueError("no training rows left")
        wanted = _quota_table(classes, n, n_test).select("cls", "n", F.array("quota").alias("bounds"))
        return _cut_by_table(df, target, h, key, wanted, n, col, lambda i: F.when(i == 0, TEST).otherwise(TRAIN))
    n = sum(counts.values())
    if min(counts.values()) < 2:
        return split_random(df, key, test_size, seed, col=col)
    n_test = math.ceil(test_size * n)
    if n_test >= n:
        raise ValueError("no training rows left")
    quotas = stratified_quotas(counts, n_test)
    inner = [(c, q) for c, q in quotas.items() if 0 < q < counts[c]]
    found = {}
    if inner:
        ordered = df.select(F.col(target).alias("_g"), h.alias("_h"), F.col(key).alias("_k"))
        cuts = lexi_cutoffs(ordered, ("_h", "_k"), inner, group="_g", counts=counts)
        found = {c: cut for (c, _), cut in zip(inner, cuts)}
    table = {}
    for c, q in quotas.items():
        if c in found:
            table[c] = ([found[c]], None)
        else:
            table[c] = ([], 0 if q == counts[c] else 1)  # 0 cut points before: all test; else all train
    return _apply_group_cuts(df, target, h, key, table, col, lambda i: F.when(i == 0, TEST).otherwise(TRAIN))


def split_time(df: DataFrame, time_col: str, key: str, test_size: float = 0.2, col: str = "split") -> DataFrame:
    """Time split: rows in ``(time, key)`` order; the last ``round(test_size * n)`` rows
    (half to even, at least 1, at most n-1) are test."""
    _check_share(test_size)
    require_columns(df, [time_col, key])
    if not is_datetime_type(df.schema[time_col].dataType):
        raise ValueError(f"time column {time_col!r} is not a date or timestamp")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(time_col).alias("present")).first()
    n = row["n"]
    if n < 2:
        raise ValueError("a time split needs at least two rows")
    if row["present"] != n:
        raise ValueError(f"time column {time_col!r} has missing values; drop or fill them first")
    n_test = min(max(round(test_size * n), 1), n - 1)
    ordered = df.select(F.col(time_col).alias("_t"), F.col(key).alias("_k"))
    (cut,) = lexi_cutoffs(ordered, ("_t", "_k"), [(0, n - n_test)], counts={0: n})
    return df.withColumn(col, F.when(before(F.col(time_col), F.col(key), cut), TRAIN).otherwise(TEST))


def fold_sizes(n: int, k: int) -> list[int]:
    q, r = divmod(n, k)
    return [q + 1 if f < r else q for f in range(k)]


def _bounds(sizes: list[int]) -> list[int]:
    out, acc = [], 0
    for s in sizes[:-1]:
        acc += s
        out.append(acc)
    return out


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """Shuffled k folds: in hash order, contiguous blocks of sizes ``n//k (+1 for the first
    n % k folds)``; ``k`` is lowered to ``n`` for tiny tables and must be at least 2."""
    require_columns(df, [key])
    n = df.count()
    k = min(k, n)
    if k < 2:
        raise ValueError(f"k-fold needs at least two folds and two rows (n={n})")
    h = hash_order(key, seed)
    ordered = df.select(h.alias("_h"), F.col(key).alias("_k"))
    cuts = lexi_cutoffs(ordered, ("_h", "_k"), [(0, b) for b in _bounds(fold_sizes(n, k))], counts={0: n})
    return df.withColumn(col, _cut_column(h, F.col(key), cuts).cast("int"))


def stratified_fold_sizes(counts: dict, k: int) -> dict:
    """Fold sizes per class: ``n_c // k`` each, and the ``n_c % k`` extra rows of each class
    go to the folds that follow the previous class's extras (in class order), so fold
    sizes stay within one row of each other."""
    out, start = {}, 0
    for c in sorted(counts):
        q, e = divmod(counts[c], k)
        extra = {(start + j) % k for j in range(e)}
        out[c] = [q + (1 if f in extra else 0) for f in range(k)]
        start = (start + e) % k
    return out


def kfold_stratified(df: DataFrame, key: str, target: str, k: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """Stratified k folds: each class is cut into k blocks in hash order. If the smallest
    class has fewer than k rows, k becomes max(2, smallest); below 2, plain k-fold."""
    require_columns(df, [key, target])
    counts = _class_counts(df, target)
    h = hash_order(key, seed)
    classes = n = None
    if counts is None:
        classes, n, _, smallest = _class_table(df, target)
    else:
        smallest = min(counts.values())
    if smallest < 2:
        return kfold(df, key, k, seed, col)
    if smallest < k:
        k = max(2, smallest)
    if counts is None:
        return _cut_by_table(df, target, h, key, _fold_table(classes, k), n, col, lambda i: i.cast("int"))
    sizes = stratified_fold_sizes(counts, k)
    targets = [(c, b) for c in sorted(counts) for b in _bounds(sizes[c])]
    ordered = df.select(F.col(target).alias("_g"), h.alias("_h"), F.col(key).alias("_k"))
    cuts = lexi_cutoffs(ordered, ("_h", "_k"), targets, group="_g", counts=counts)
    table: dict = {c: ([], None) for c in counts}
    for (c, _), cut in zip(targets, cuts):
        table[c][0].append(cut)
    return _apply_group_cuts(df, target, h, key, table, col, lambda i: i.cast("int"))
