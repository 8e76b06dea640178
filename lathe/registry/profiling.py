"""Registered queries for sources, validation, profiling and problem setup (S, V, P, D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import problem, profile, quality
from ..session import ensure_checkpoint_dir
from ..sources import io
from .sqlgen import NUMERIC, R, TABLE_COLUMNS, profile_sql, q, stats_sql


def T(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scan_csv(spark, sf):
    region = T(spark, sf, "region")
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scan_csv-{uuid.uuid4().hex}.csv"
    region.write.mode("overwrite").option("header", True).csv(out)
    return io.read_table(spark, out, schema="r_regionkey int, r_name string")


def _scan_csv_quoted(spark, sf):
    """Cells with separators, doubled quotes and line breaks, written and read back."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scan_csv-{uuid.uuid4().hex}.csv"
    said = F.concat(F.lit('He said "'), "lang", F.lit('", \\ok\r\n"" '), "text", F.lit(' "'))
    io.write_csv(T(spark, sf, "documents").select("doc_id", said.alias("said"), F.concat(F.lit('"'), "source").alias("q"), "n_chars"), out)
    return io.read_table(spark, out, schema="doc_id long, said string, q string, n_chars long")


def _scan_csv_missing(spark, sf):
    """Cells that say ``NA`` or ``null``, and types inferred after those are missing."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scan_csv-{uuid.uuid4().hex}.csv"
    src = T(spark, sf, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") < 0, "NA").otherwise(F.col("s_acctbal").cast("string")).alias("s_acctbal"),
        F.when(F.col("s_nationkey") % 2 == 0, "null").otherwise(F.col("s_name")).alias("s_name"))
    src.write.mode("overwrite").option("header", True).csv(out)
    return io.read_table(spark, out)


def _merge_mixed(spark, sf):
    """A column that is a number in one table and text in the other."""
    n = T(spark, sf, "nation")
    return io.merge_tables([n.select(F.col("n_nationkey").alias("k"), "n_regionkey"), n.select("n_regionkey", F.col("n_name").alias("k"))])


def _sample_fine(spark, sf):
    """Values that a double or a second would make equal."""
    e = T(spark, sf, "events").select((F.col("event_id") + F.lit(2**53)).alias("big"), (F.col("ts") + F.expr("INTERVAL 1 MICROSECOND") * F.col("event_id")).alias("fine"))
    return profile.sample_values(e, 3).select("column_name", "rank", "text_value")


def _merge(spark, sf):
    o = T(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'")
    b = o.where("o_orderstatus = 'O'").select(*reversed(o.columns))
    c = o.where("o_orderstatus = 'P'")
    return io.merge_tables([a, b, c])


def _lineitem_nullif(spark, sf):
    return T(spark, sf, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))


def _docs_labels(spark, sf):
    return T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")


def _part_copy(spark, sf):
    return T(spark, sf, "part").withColumn("p_size_copy", F.col("p_size"))


REG_FAMILIES = ("linear_regression", "random_forest", "gradient_boosting")

QUERIES = {
    "scan_csv": _scan_csv,
    "scan_parquet": lambda s, sf: io.read_table(s, f"{sf}/orders.parquet"),
    "merge_tables": _merge,
    "scan_csv_missing": _scan_csv_missing,
    "scan_csv_quoted": _scan_csv_quoted,
    "merge_tables_mixed": _merge_mixed,
    "sample_values_fine": _sample_fine,
    "preview": lambda s, sf: io.preview(T(s, sf, "orders"), "o_orderkey", 5),
    "table_metadata": lambda s, sf: io.metadata(T(s, sf, "orders")),
    "validate_table": lambda s, sf: quality.validation_flags(quality.validate(T(s, sf, "orders"))),
    "identical_columns": lambda s, sf: quality.identical_columns_report(_part_copy(s, sf)),
    "drop_identical_columns": lambda s, sf: quality.drop_identical_columns(_part_copy(s, sf)),
    "duplicate_rows": lambda s, sf: quality.duplicate_report(T(s, sf, "documents").drop("doc_id")),
    "duplicate_rows_subset": lambda s, sf: quality.duplicate_report(T(s, sf, "lineitem"), ["l_returnflag", "l_linestatus"]),
    "missing_values": lambda s, sf: quality.missing_report(_lineitem_nullif(s, sf)),
    "missing_values_joined": lambda s, sf: quality.missing_report(_docs_labels(s, sf)),
    "drop_missing_target": lambda s, sf: quality.drop_missing_target(_docs_labels(s, sf), "toxic").drop("text"),
    "numeric_stats": lambda s, sf: profile.numeric_stats(T(s, sf, "lineitem")),
    "numeric_stats_missing": lambda s, sf: profile.numeric_stats(_lineitem_nullif(s, sf).select("l_discount", "l_tax")),
    "column_profile": lambda s, sf: profile.column_profile(T(s, sf, "orders")),
    "column_profile_approx": lambda s, sf: profile.column_profile(T(s, sf, "orders"), exact=False),
    "sample_values": lambda s, sf: profile.sample_values(T(s, sf, "orders")),
    "first_values": lambda s, sf: profile.first_values(io.read_table(s, f"{sf}/lineitem.parquet", position=True)),
    "preview_file_order": lambda s, sf: io.preview(io.read_table(s, f"{sf}/events.parquet", position=True)),
    "class_balance": lambda s, sf: profile.class_balance(T(s, sf, "labels"), "toxic"),
    "class_balance_events": lambda s, sf: profile.class_balance(T(s, sf, "events"), "event_type"),
    "imbalance_flag": lambda s, sf: profile.imbalance_flag(T(s, sf, "events"), "event_type"),
    "analysis_report": lambda s, sf: profile.analyze(T(s, sf, "orders"), "o_orderstatus"),
    "dataset_context": lambda s, sf: profile.dataset_context(T(s, sf, "orders")),
    "infer_problem": lambda s, sf: problem.infer_problem_table(T(s, sf, "part")),
    "problem_type_by_column": lambda s, sf: problem.problem_type_by_column(T(s, sf, "customer")),
    "column_actions": lambda s, sf: problem.recommend_actions(T(s, sf, "part"), "p_retailprice", REG_FAMILIES),
}


def _type_case(p="p"):
    return (
        f"CASE WHEN {p}.is_categorical OR {p}.unique_values = 2 THEN 'classification' "
        f"WHEN {p}.is_numeric AND {p}.unique_values <= 20 AND {p}.unique_percentage <= 5.0 THEN 'classification' "
        f"WHEN {p}.is_numeric THEN 'regression' END"
    )


def _metadata_sql():
    rows = []
    for i, (c, t) in enumerate(TABLE_COLUMNS["orders"]):
        kind = "numeric" if t in NUMERIC else "categorical" if t == "string" else "datetime"
        rows.append(f"({q(c)}, {i}, {q(t)}, {q(kind)})")
    return (
        "SELECT m.column_name, CAST(m.position AS INTEGER) AS position, m.dtype, m.kind, "
        "(SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns FROM (VALUES "
        + ", ".join(rows) + ") m(column_name, position, dtype, kind)"
    )


def _identical_sql():
    cols = TABLE_COLUMNS["part"] + [("p_size_copy", "int")]
    src = "(SELECT *, p_size AS p_size_copy FROM part)"
    parts = []
    for j, (b, tb) in enumerate(cols):
        for i, (a, ta) in enumerate(cols[:j]):
            if ta == tb:
                parts.append(
                    f"SELECT {q(b)} AS column_name, {q(a)} AS same_as, {i} AS pa, "
                    f"bool_and({a} IS NOT DISTINCT FROM {b}) AS eq FROM {src}"
                )
    inner = " UNION ALL ".join(parts)
    # a later column is reported against the first earlier column it equals
    return (
        f"SELECT column_name, min_by(same_as, pa) AS same_as FROM ({inner}) WHERE eq GROUP BY column_name"
    )


def _missing_sql(source, cols):
    parts = []
    for i, (c, t) in enumerate(cols):
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if t == "double" else "")
        parts.append(
            f"SELECT {q(c)} AS column_name, {i} AS position, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS missing_count, "
            f"{R(f'count(*) FILTER (WHERE {cond}) * 100.0 / count(*)')} AS missing_percentage FROM {source}"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE missing_count > 0"


_DOCS_LABELS_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                     ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]
_DOCS_LABELS = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_LI_NULLIF = "(SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem)"


def _balance_sql(table, target):
    return (
        f"WITH c AS (SELECT CAST({target} AS VARCHAR) AS class_value, count(*) AS count FROM {table} "
        f"WHERE {target} IS NOT NULL GROUP BY {target}), t AS (SELECT sum(count) AS total, min(count) AS smallest FROM c) "
        f"SELECT class_value, CAST(count AS BIGINT) AS count, {R('count * 100.0 / total')} AS percentage, "
        f"(smallest * 100.0 / total < 20.0) AS imbalanced FROM c, t"
    )


def _analysis_sql():
    cols = TABLE_COLUMNS["orders"]
    prof = profile_sql("orders")
    stats = stats_sql("orders", cols)
    bal = _balance_sql("orders", "o_orderstatus")
    metrics_p = ["unique_values", "unique_percentage", "missing_count", "missing_percentage", "is_numeric",
                 "is_categorical", "is_datetime"]
    parts = [
        f"SELECT 'missing' AS section, column_name, 'missing_count' AS metric, CAST(missing_count AS DOUBLE) AS value FROM ({_missing_sql('orders', cols)})",
        f"SELECT 'missing', column_name, 'missing_percentage', missing_percentage FROM ({_missing_sql('orders', cols)})",
        "SELECT 'duplicates', NULL, 'duplicate_rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS DOUBLE) FROM orders",
        f"SELECT 'duplicates', NULL, 'duplicate_percentage', {R('(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))) * 100.0 / count(*)')} FROM orders",
    ]
    for m in ("mean", "median", "std", "min", "max"):
        parts.append(f"SELECT 'statistics', column_name, '{m}', {m} FROM ({stats})")
    for m in metrics_p:
        parts.append(f"SELECT 'profile', column_name, '{m}', CAST({m} AS DOUBLE) FROM ({prof})")
    parts += [
        f"SELECT 'balance', class_value, 'count', CAST(count AS DOUBLE) FROM ({bal})",
        f"SELECT 'balance', class_value, 'percentage', percentage FROM ({bal})",
        f"SELECT DISTINCT 'balance', NULL, 'imbalanced', CAST(imbalanced AS DOUBLE) FROM ({bal})",
    ]
    return "\nUNION ALL\n".join(parts)


def _context_sql():
    cols = TABLE_COLUMNS["orders"]
    return (
        f"SELECT p.position, p.column_name, p.dtype, p.unique_values, p.unique_percentage, p.missing_count, "
        f"p.missing_percentage, p.is_numeric, p.is_categorical, p.is_datetime, s.mean, s.median, s.std, s.min, s.max, "
        f"(SELECT count(*) FROM orders) AS n_rows, "
        f"(SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows "
        f"FROM ({profile_sql('orders')}) p LEFT JOIN ({stats_sql('orders', cols)}) s USING (position)"
    )


def _infer_sql():
    cols = TABLE_COLUMNS["part"]
    target = cols[-1][0]
    feats = ", ".join(f"({q(c)}, {i})" for i, (c, _) in enumerate(cols[:-1]))
    tprof = profile_sql("part", [cols[-1]])
    return (
        f"WITH p AS ({tprof}), t AS (SELECT {_type_case()} AS problem_type FROM p) "
        f"SELECT {q(target)} AS target, t.problem_type, CASE t.problem_type WHEN 'classification' THEN 'f1' ELSE 'rmse' END AS metric, "
        f"f.feature, CAST(f.position AS INTEGER) AS position FROM t, (VALUES {feats}) f(feature, position)"
    )


def _actions_sql():
    p = "p"
    name = f"lower({p}.column_name)"
    is_id = (f"({name} LIKE '%id' OR {name} IN ('id','uuid','guid','ticket','name') OR "
             f"({p}.is_numeric AND {p}.unique_percentage > 95.0 AND {p}.unique_values > 50))")
    is_text = f"({p}.is_categorical AND ({p}.unique_values > 30 OR {p}.unique_percentage > 40.0))"
    drop = f"({is_id} OR {is_text})"
    return (
        f"SELECT column_name, position, CASE WHEN {drop} THEN 'drop' WHEN is_numeric THEN 'keep' "
        f"WHEN is_categorical THEN 'one_hot' WHEN is_datetime THEN 'datetime_extract' ELSE 'passthrough' END AS action, "
        f"CASE WHEN NOT {drop} AND is_numeric AND missing_count > 0 THEN 'median' "
        f"WHEN NOT {drop} AND NOT is_numeric AND is_categorical AND missing_count > 0 THEN 'mode' END AS impute, "
        f"CASE WHEN NOT {drop} AND is_numeric THEN 'standard' END AS scale "
        f"FROM ({profile_sql('part')}) p WHERE column_name <> 'p_retailprice'"
    )


def _sample_sql(table="orders", order="num_value, text_value"):
    parts = []
    for i, (c, t) in enumerate(TABLE_COLUMNS[table]):
        if t in NUMERIC:
            num = f"CAST({c} AS DOUBLE) + 0.0"
            txt = "CAST(NULL AS VARCHAR)" if t in ("double", "float", "boolean") else f"CAST({c} AS VARCHAR)"
        elif t in ("timestamp_ntz", "timestamp"):
            num, txt = "CAST(NULL AS DOUBLE)", f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"
        else:
            num, txt = "CAST(NULL AS DOUBLE)", f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT {q(c)} AS column_name, {i} AS position, {num} AS num_value, {txt} AS text_value, min(file_row) AS seen "
                     f"FROM (SELECT *, row_number() OVER () AS file_row FROM {table}) WHERE {c} IS NOT NULL GROUP BY ALL")
    return (
        "SELECT column_name, position, CAST(rank AS INTEGER) AS rank, num_value, text_value FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY position ORDER BY {order}) AS rank FROM ("
        + " UNION ALL ".join(parts) + ")) WHERE rank <= 5"
    )


ORACLES = {
    "scan_csv_quoted": "SELECT doc_id, 'He said \"' || lang || '\", \\ok' || chr(13) || chr(10) || '\"\" ' || text || ' \"' AS said, "
    "'\"' || source AS q, n_chars FROM documents",
    "scan_csv": "SELECT * FROM region",
    "scan_parquet": "SELECT * FROM orders",
    "merge_tables": "SELECT * FROM orders",
    "scan_csv_missing": "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal, "
    "CASE WHEN s_nationkey % 2 <> 0 THEN s_name END AS s_name FROM supplier",
    "merge_tables_mixed": "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_regionkey FROM nation UNION ALL SELECT n_name, n_regionkey FROM nation",
    "sample_values_fine": "WITH v AS (SELECT event_id + 9007199254740992 AS big, ts + to_microseconds(event_id) AS fine FROM events) "
    "SELECT * FROM (SELECT 'big' AS column_name, CAST(row_number() OVER (ORDER BY big) AS INTEGER) AS rank, CAST(big AS VARCHAR) AS text_value "
    "FROM (SELECT DISTINCT big FROM v) UNION ALL SELECT 'fine', CAST(row_number() OVER (ORDER BY fine) AS INTEGER), "
    "strftime(fine, '%Y-%m-%dT%H:%M:%S.%f') FROM (SELECT DISTINCT fine FROM v)) WHERE rank <= 3",
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "table_metadata": _metadata_sql(),
    "validate_table": "SELECT 6 AS n_columns, (SELECT count(*) = 0 FROM orders) AS is_empty, 0 AS repeated_names, "
    "(SELECT count(*) > 0 FROM orders) AS valid",
    "identical_columns": _identical_sql(),
    "drop_identical_columns": "SELECT * FROM part",
    "duplicate_rows": "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS BIGINT) AS duplicate_rows, "
    "count(*) AS total_rows, "
    + R("(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents))) * 100.0 / count(*)")
    + " AS duplicate_percentage FROM documents",
    "duplicate_rows_subset": "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) AS BIGINT) AS duplicate_rows, "
    "count(*) AS total_rows, "
    + R("(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem))) * 100.0 / count(*)")
    + " AS duplicate_percentage FROM lineitem",
    "missing_values": _missing_sql(_LI_NULLIF, TABLE_COLUMNS["lineitem"]),
    "missing_values_joined": _missing_sql(_DOCS_LABELS, _DOCS_LABELS_COLS),
    "drop_missing_target": f"SELECT * EXCLUDE (text) FROM {_DOCS_LABELS} WHERE toxic IS NOT NULL",
    "numeric_stats": stats_sql("lineitem", TABLE_COLUMNS["lineitem"]),
    "numeric_stats_missing": stats_sql(f"(SELECT l_discount, l_tax FROM {_LI_NULLIF})", [("l_discount", "double"), ("l_tax", "double")]),
    "column_profile": profile_sql("orders"),
    "sample_values": _sample_sql(),
    "first_values": _sample_sql("lineitem", "seen"),
    "preview_file_order": "SELECT * FROM events LIMIT 5",
    "class_balance": _balance_sql("labels", "toxic"),
    "class_balance_events": _balance_sql("events", "event_type"),
    "imbalance_flag": "WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1) "
    "SELECT min(n) * 100.0 / sum(n) < 20.0 AS imbalanced, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS total FROM c",
    "analysis_report": _analysis_sql(),
    "dataset_context": _context_sql(),
    "infer_problem": _infer_sql(),
    "problem_type_by_column": f"SELECT column_name, position, {_type_case()} AS problem_type FROM ({profile_sql('customer')}) p",
    "column_actions": _actions_sql(),
}
