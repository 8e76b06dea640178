"""Feature selection fitted on the training rows: none, variance, correlation, mutual
information (binned), model importance. Each returns a long report
``column_name, position, score, rank, selected`` and the kept column list.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, is_missing, is_number_type
from ..functions.quantiles import exact_quantiles
from ..session import cut_lineage

METHODS = ("none", "variance", "correlation", "mutual_info", "model")


class SelectionError(ValueError):
    pass


def resolve_candidates(df: DataFrame, candidates: list[str], lineage: dict | None = None) -> list[str]:
    """Candidates still present, expanded through column lineage (original -> derived
    columns, e.g. a one-hot source to its indicator columns). When none remain, every
    column but the target is a candidate (the caller passes that list as fallback)."""
    lineage = lineage or {}
    out = []
    for c in candidates:
        if c in df.columns and c not in out:
            out.append(c)
        for d in lineage.get(c, []):
            if d in df.columns and d not in out:
                out.append(d)
    return out


def _x(df, c):
    return clean(c, df.schema[c].dataType).cast("double")


def variance_scores(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.var_pop(_x(df, c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


#: Columns up to which all pairs are sums of one plain aggregation; beyond, matrix products.
NARROW = 8
#: Cells (pairs of columns) that a task sums up at once, and edges that one task orders.
CELLS = 1_500_000
EDGES = 5_000_000
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _centred(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as ``c0``, ``c1``, ... less their means: no digits are lost in the sums."""
    means = df.agg(*[F.avg(_x(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return df.select(*[(_x(df, c) - F.lit(means[f"m{i}"] or 0.0)).alias(f"c{i}") for i, c in enumerate(cols)])


def correlations(df: DataFrame, cols: list[str], above: float | None = None) -> DataFrame:
    """``i, j, abs_corr``: absolute Pearson correlation of each pair (places in ``cols``, i < j)
    over the rows where both are present, null where one doesn't vary; with ``above`` only the
    pairs over it.

    The sums n, x, y, x^2, y^2 and xy of a pair are those of one aggregation for a few columns.
    Beyond, each Arrow batch adds them for a strip of columns against all later ones as products
    of its value and presence matrices; a task holds ``CELLS`` cells, sends a row of sums for each
    column, and the rows of a column are added up and judged in one task. Strips are read one
    after another, so memory doesn't grow with the square of the columns.
    """
    k, spark = len(cols), df.sparkSession
    schema = "i int, j int, abs_corr double"
    if k < 2:
        return spark.createDataFrame([], schema)
    if k <= NARROW:
        x, sums = _centred(df, cols), []
        for i in range(k):
            for j in range(i + 1, k):
                a, b = (F.when(F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull(), F.col(f"c{c}")) for c in (i, j))
                cells = [F.count(a).cast("double"), *[F.coalesce(F.sum(v), F.lit(0.0)) for v in (a, b, a * a, b * b, a * b)]]
                sums.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[c.alias(s) for c, s in zip(cells, _SUMS)]))
        pairs = x.agg(F.array(*sums).alias("p")).select(F.inline("p"))
        n, sx, sy, sxx, syy, sxy = (F.col(s) for s in _SUMS)
        va, vb = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
        varies = (n > 0) & (va > 1e-15 * (sxx / n + 1e-300)) & (vb > 1e-15 * (syy / n + 1e-300))
        out = pairs.select("i", "j", F.when(varies, F.abs(sxy / n - sx / n * sy / n) / F.sqrt(va * vb)).alias("abs_corr"))
        return out if above is None else out.where(F.col("abs_corr") > above)

    # one array column: a plan of a few expressions, however many columns
    cells = df.select(F.array(*[_x(df, c) for c in cols]).alias("v"))

    def matrix(batch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k)

    def totals(batches):
        total = np.zeros((k, 2))
        for batch in batches:
            v = matrix(batch)
            total += np.stack([np.nansum(v, axis=0), (~np.isnan(v)).sum(0)], axis=1)
        yield pa.record_batch([pa.array(np.arange(k), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["i", "s", "n"])

    means = np.zeros(k)
    for r in cells.mapInArrow(totals, "i int, s double, n double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        means[r["i"]] = r["s"] / r["n"] if r["n"] else 0.0

    def strip(lo: int, hi: int):
        def partial(batches):
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch)[:, lo:] - means[lo:]
                here = (~np.isnan(v)).astype(np.float64)
                v = np.nan_to_num(v, nan=0.0)
                a, ha = v[:, : hi - lo], here[:, : hi - lo]
                sums = np.stack([ha.T @ here, a.T @ here, ha.T @ v, (a * a).T @ here, ha.T @ (v * v), a.T @ v], axis=-1)
                total = sums if total is None else total + sums
            if total is not None:
                yield pa.record_batch([pa.array(np.arange(lo, hi), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary()), pa.array([lo] * (hi - lo), pa.int32())], names=["i", "sums", "lo"])

        return cells.mapInArrow(partial, "i int, sums binary, lo int")

    def judged(key, parts):
        i, lo = key[0].as_py(), parts.column("lo")[0].as_py()
        total = sum(np.frombuffer(b.as_buffer(), np.float64).reshape(-1, len(_SUMS)) for b in parts.column("sums"))[i - lo + 1 :]
        with np.errstate(all="ignore"):
            n, sx, sy, sxx, syy, sxy = total.T
            va, vb = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
            varies = (n > 0) & (va > 1e-15 * (sxx / n + 1e-300)) & (vb > 1e-15 * (syy / n + 1e-300))
            corr = np.where(varies, np.abs(sxy / n - sx / n * sy / n) / np.sqrt(va * vb), np.nan)
        at = np.arange(len(corr)) if above is None else np.flatnonzero(corr > above)
        return pa.table({"i": pa.array(np.full(len(at), i), pa.int32()), "j": pa.array(at + i + 1, pa.int32()), "abs_corr": pa.array(corr[at], from_pandas=True)})

    width = max(1, CELLS // k)
    strips = [strip(lo, min(lo + width, k)) for lo in range(0, k - 1, width)]
    return reduce(DataFrame.unionByName, strips).groupBy("i").applyInArrow(judged, schema)


def correlation_matrix(df: DataFrame, cols: list[str]) -> dict:
    """:func:`correlations` as a dictionary by names, both ways (on the driver: for few columns)."""
    out = {}
    for r in correlations(df, cols).collect():
        out[(cols[r["i"]], cols[r["j"]])] = out[(cols[r["j"]], cols[r["i"]])] = r["abs_corr"]
    return out


def greedy_removed(edges: DataFrame) -> list[int]:
    """The places that the greedy rule removes: in order, each kept place removes every later one
    that an edge (``i`` < ``j``) joins it to.

    Above ``EDGES`` edges, rounds in Spark settle whatever has no earlier neighbour left: it is
    kept, its neighbours go, and so do all their edges. The rest is streamed in order through
    one task, which remembers the removed places. Only these reach the driver.
    """
    edges = cut_lineage(edges.select("i", "j"))
    gone: set[int] = set()
    while edges.count() > EDGES:
        first = edges.select("i").distinct().join(edges.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        now = edges.join(first, "i").select("j").distinct()
        gone |= {r["j"] for r in now.collect()}
        rest = edges.join(now.select(F.col("j").alias("i")).unionByName(first).distinct(), "i", "left_anti")
        edges = cut_lineage(rest.join(now, "j", "left_anti").select("i", "j"))

    def settle(batches):
        out: set[int] = set()
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i not in out:
                    out.add(j)
        yield pa.record_batch([pa.array(sorted(out), pa.int32())], names=["j"])

    ordered = edges.repartition(1).sortWithinPartitions("i", "j")
    return sorted(gone | {r["j"] for r in ordered.mapInArrow(settle, "j int").collect()})


def mutual_info_scores(df: DataFrame, cols: list[str], target: str, bins: int = 10,
                       target_bins: int | None = None) -> dict:
    """Binned mutual information (nats) between each column and the target.

    Numeric columns are cut at their exact quantiles ``1/bins .. (bins-1)/bins`` (bin =
    number of cut points strictly below the value); other columns use their values. A
    numeric target is binned the same way when ``target_bins`` is given. Then one
    ``groupBy(column, bin, y).count()`` contingency table and sum p*ln(p/(px*py)).
    """
    num = [c for c in cols if is_number_type(df.schema[c].dataType)]
    probs = [j / bins for j in range(1, bins)]
    cuts = exact_quantiles(df, num, probs) if num else {}
    tdt = df.schema[target].dataType
    y = F.col(target).cast("string")
    if target_bins:
        tq = exact_quantiles(df, [target], [j / target_bins for j in range(1, target_bins)])[target]
        tx = _x(df, target)
        y = sum((F.when(tx > F.lit(v), 1).otherwise(0) for v in tq), F.lit(0)).cast("string")

    def bin_of(c):
        if c in cuts:
            x = _x(df, c)
            return F.when(x.isNotNull(), sum((F.when(x > F.lit(v), 1).otherwise(0) for v in cuts[c]), F.lit(0)).cast("string"))
        return F.when(~is_missing(c, df.schema[c].dataType), F.col(c).cast("string"))

    parts = [F.struct(F.lit(i).alias("g"), bin_of(c).alias("b")) for i, c in enumerate(cols)]
    long = (
        df.where(~is_missing(target, tdt))
        .select(y.alias("y"), F.explode(F.array(*parts)).alias("_c"))
        .select("_c.g", "_c.b", "y")
        .where(F.col("b").isNotNull())
    )
    cont = long.groupBy("g", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    px = cont.groupBy("g", "b").agg(F.sum("n").alias("nx"))
    py = cont.groupBy("g", "y").agg(F.sum("n").alias("ny"))
    tot = cont.groupBy("g").agg(F.sum("n").alias("nt"))
    mi = (
        cont.join(px, ["g", "b"]).join(py, ["g", "y"]).join(tot, "g")
        .groupBy("g")
        .agg(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mi"))
    )
    found = {r["g"]: r["mi"] for r in mi.collect()}
    return {c: max(found.get(i, 0.0) or 0.0, 0.0) for i, c in enumerate(cols)}


def _report(spark, cols, scores, selected, ranked: bool):
    order = sorted(cols, key=lambda c: (-(scores.get(c) if scores.get(c) is not None else -math.inf), c)) if ranked else cols
    rank = {c: i + 1 for i, c in enumerate(order)}
    rows = [(c, i, None if scores.get(c) is None else float(scores[c]), rank[c] if ranked else None, c in selected)
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column_name string, position int, score double, rank int, selected boolean")


def select_features(df: DataFrame, candidates: list[str], target: str, method: str = "none",
                    threshold: float | None = None, max_features: int | None = None, problem_type: str = "classification",
                    lineage: dict | None = None, bins: int = 10, seed: int = 42):
    """Fit a selection on ``df`` (the training rows). Returns ``(selected, report)``."""
    if method not in METHODS:
        raise SelectionError(f"unknown selection method {method!r}")
    cols = resolve_candidates(df, candidates, lineage)
    if not cols:
        cols = [c for c in df.columns if c != target]
    if method in ("mutual_info", "model"):
        if max_features is None:
            raise SelectionError(f"{method} selection needs max_features")
        if not 0 < max_features <= len(cols):
            raise SelectionError(f"max_features must be in 1..{len(cols)}")
    spark = df.sparkSession
    scores: dict = {}
    ranked = False
    if method == "none":
        selected = list(cols)
    elif method == "variance":
        t = 0.0 if threshold is None else threshold
        scores = variance_scores(df, cols)
        selected = [c for c in cols if scores[c] is not None and scores[c] > t]
    elif method == "correlation":
        t = 0.95 if threshold is None else threshold
        removed = set(greedy_removed(correlations(df, cols, t)))
        selected = [c for i, c in enumerate(cols) if i not in removed]
    else:
        if method == "mutual_info":
            scores = mutual_info_scores(df, cols, target, bins, target_bins=bins if problem_type == "regression" else None)
        else:
            from .models import forest_importances

            scores = forest_importances(df, cols, target, problem_type, seed)
        ranked = True
        order = sorted(cols, key=lambda c: (-scores[c], c))
        selected = order[:max_features]
    return selected, _report(spark, cols, scores, set(selected), ranked)


def correlation_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """The absolute correlation matrix as a long table ``column_a, column_b, abs_corr``."""
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(cols)), "i int, name string")
    own = names.select(F.col("name").alias("column_a"), F.col("name").alias("column_b"), F.lit(1.0).alias("abs_corr"))
    pairs = correlations(df, cols).join(names.toDF("i", "a"), "i").join(names.toDF("j", "b"), "j")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("column_a"), F.col("b").alias("column_b")), F.struct(F.col("b").alias("column_a"), F.col("a").alias("column_b")))).alias("p"), "abs_corr")
    return own.unionByName(both.select("p.*", "abs_corr"))
