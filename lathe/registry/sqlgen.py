"""Helpers that write the SQL oracles (DuckDB dialect) for the registered queries."""

from __future__ import annotations

# Column lists and Spark type names of the test tables used by the oracles.
TABLE_COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
}

NUMERIC = {"int", "bigint", "double", "float", "smallint", "tinyint", "boolean"}
TEXT = {"string"}
DATETIME = {"timestamp_ntz", "timestamp", "date"}


def R(expr: str, d: int = 2) -> str:
    """Round like Spark's ``round`` on a double (half-up on the shortest decimal form)."""
    x = f"CAST(({expr}) AS DOUBLE)"
    return f"(CASE WHEN isfinite({x}) THEN CAST(round(CAST({x} AS DECIMAL(38,12)), {d}) AS DOUBLE) ELSE {x} END)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def profile_sql(table: str, cols=None) -> str:
    """One row per column with the profile fields (distinct, missing, flags)."""
    cols = cols or TABLE_COLUMNS[table]
    parts = []
    for i, (c, t) in enumerate(cols):
        miss = f"count(*) FILTER (WHERE {c} IS NULL" + (f" OR isnan({c})" if t in ("double", "float") else "") + ")"
        parts.append(
            f"SELECT {q(c)} AS column_name, {i} AS position, {q(t)} AS dtype, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values, "
            f"CASE WHEN count(*) > 0 THEN {R(f'count(DISTINCT {c}) * 100.0 / count(*)')} ELSE 0.0 END AS unique_percentage, "
            f"CAST({miss} AS BIGINT) AS missing_count, "
            f"CASE WHEN count(*) > 0 THEN {R(f'{miss} * 100.0 / count(*)')} ELSE 0.0 END AS missing_percentage, "
            f"{'true' if t in NUMERIC else 'false'} AS is_numeric, "
            f"{'true' if (t in TEXT or t == 'boolean') else 'false'} AS is_categorical, "
            f"{'true' if t in DATETIME else 'false'} AS is_datetime FROM {table}"
        )
    return "\nUNION ALL\n".join(parts)


def stats_sql(source: str, cols) -> str:
    """One row per numeric column: mean, median, std, min, max (2 decimals, 0.0 if undefined)."""
    parts = []
    for i, (c, t) in enumerate(cols):
        if t not in NUMERIC:
            continue
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {q(c)} AS column_name, {i} AS position, "
            f"coalesce({R(f'avg({x})')}, 0.0) AS mean, coalesce({R(f'quantile_cont({x}, 0.5)')}, 0.0) AS median, "
            f"coalesce({R(f'stddev_samp({x})')}, 0.0) AS std, coalesce({R(f'min({x})')}, 0.0) AS min, "
            f"coalesce({R(f'max({x})')}, 0.0) AS max FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)
