"""Registered queries for preprocessing (F1-F13) and feature engineering (E1-E7).

Fitted operators are fitted on the older rows (dates before 1998) and applied to all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engineer as fe
from ..operators import prep
from .profiling import T
from .sqlgen import R

CUT = "1998-01-01"


def _li(s, sf):
    return T(s, sf, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))


def _orders(s, sf):
    return T(s, sf, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))


def _fit_apply(df, date_col, steps):
    model = prep.PrepPipeline(steps).fit(df.where(F.col(date_col) < F.lit(CUT).cast("timestamp_ntz")))
    return model.transform(df)


def _r(df, keep, cols, d=6):
    return df.select(*keep, *[F.round(F.col(f"`{c}`"), d).alias(c) for c in cols])


def _li_prep(steps, cols):
    return lambda s, sf: _r(_fit_apply(_li(s, sf), "l_shipdate", steps), ["l_orderkey", "l_linenumber"], cols)


def _orders_prep(steps, cols=None, rounded=False):
    def run(s, sf):
        out = _fit_apply(_orders(s, sf), "o_orderdate", steps)
        names = cols or [c for c in out.columns if c.startswith("o_orderpriority")]
        return _r(out, ["o_orderkey"], names) if rounded else out.select("o_orderkey", *[F.col(f"`{c}`") for c in names])
    return run


def _chain(s, sf):
    steps = [
        prep.Impute(["l_discount"], "s1", "median"),
        prep.Impute(["l_linestatus"], "s2", "mode"),
        prep.OneHot(["l_returnflag"], "s3"),
        prep.Scale(["l_quantity"], "s4", "standard"),
        prep.Scale(["l_extendedprice"], "s5", "robust"),
        prep.Passthrough(["l_tax"], "s6"),
        prep.DatetimeParts(["l_shipdate"], "s7"),
        prep.Drop(["l_partkey", "l_suppkey", "l_linestatus"], "s8"),
    ]
    out = _fit_apply(_li(s, sf), "l_shipdate", steps)
    dbl = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, 6).alias(c) if c in dbl else F.col(c) for c in out.columns])


def _fe(steps, outs):
    def run(s, sf):
        df = T(s, sf, "lineitem").withColumn("l_discount_m1", F.col("l_discount") - 1.0)
        out, _ = fe.engineer(df, steps)
        return _r(out, ["l_orderkey", "l_linenumber"], outs)
    return run


def _wide(s, sf):
    """Tens of categories a thousand rows: one for each place of a text of two numbers, some
    unseen in the older rows, some missing; and one value that a third of the rows share."""
    own = F.concat_ws("/", F.col("l_partkey") % 5000, F.col("l_orderkey") % 97, "l_linenumber")
    value = F.when(F.col("l_orderkey") % 3 == 0, "common").when(F.col("l_orderkey") % 11 != 1, own)
    return T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", value.alias("place"))


def _one_hot_wide(s, sf):
    df = _wide(s, sf)
    out = _fit_apply(df, "l_shipdate", [prep.OneHot(["place"], output="vector")])
    vec = F.unwrap_udt("place_onehot")
    return out.select("l_orderkey", "l_linenumber", F.get(vec["indices"], 0).alias("place"), vec["size"].alias("size"))


QUERIES = {
    "one_hot_wide": _one_hot_wide,
    "ordinal_wide": lambda s, sf: _fit_apply(_wide(s, sf), "l_shipdate", [prep.Ordinal(["place"])]).select("l_orderkey", "l_linenumber", "place"),
    "impute_mean": _li_prep([prep.Impute(["l_discount"], strategy="mean")], ["l_discount"]),
    "impute_median": _li_prep([prep.Impute(["l_discount"], strategy="median")], ["l_discount"]),
    "impute_mode": _orders_prep([prep.Impute(["o_orderpriority"], strategy="mode")], ["o_orderpriority"]),
    "impute_constant": _orders_prep([prep.Impute(["o_orderpriority"], strategy="constant", fill_value="UNKNOWN")],
                                    ["o_orderpriority"]),
    "one_hot": _orders_prep([prep.OneHot(["o_orderpriority"])]),
    "ordinal_encode": _orders_prep([prep.Ordinal(["o_orderpriority"])], ["o_orderpriority"], rounded=True),
    "scale_standard": _li_prep([prep.Scale(["l_quantity", "l_extendedprice"], method="standard")], ["l_quantity", "l_extendedprice"]),
    "scale_minmax": _li_prep([prep.Scale(["l_quantity", "l_extendedprice"], method="minmax")], ["l_quantity", "l_extendedprice"]),
    "scale_robust": _li_prep([prep.Scale(["l_quantity", "l_extendedprice"], method="robust")], ["l_quantity", "l_extendedprice"]),
    "datetime_extract": lambda s, sf: prep.PrepPipeline([prep.DatetimeParts(["ts"])]).fit(T(s, sf, "events"))
    .transform(T(s, sf, "events")).select("event_id", "ts_year", "ts_month", "ts_day", "ts_dayofweek", "ts_hour"),
    "prep_drop": lambda s, sf: prep.PrepPipeline([prep.Drop(["l_tax", "l_linestatus"])]).fit(T(s, sf, "lineitem"))
    .transform(T(s, sf, "lineitem")),
    "prep_passthrough": lambda s, sf: prep.PrepPipeline([prep.Passthrough(["l_tax"])]).fit(T(s, sf, "lineitem"))
    .transform(T(s, sf, "lineitem")),
    "prep_chain": _chain,
    "fe_interaction": _fe([fe.Interaction("l_quantity", "l_discount", "qty_x_disc")], ["qty_x_disc"]),
    "fe_ratio": _fe([fe.Ratio("l_extendedprice", "l_discount", "price_per_disc")], ["price_per_disc"]),
    "fe_difference": _fe([fe.Difference("l_extendedprice", "l_tax", "price_minus_tax")], ["price_minus_tax"]),
    "fe_log1p": _fe([fe.Log1p("l_discount_m1", "log_disc")], ["log_disc"]),
    "fe_square": _fe([fe.Square("l_quantity", "qty_sq")], ["qty_sq"]),
    "fe_datetime": lambda s, sf: fe.engineer(T(s, sf, "events"), [fe.DatetimeParts("ts", "at"), fe.Interaction("at_hour", "value", "hour_value")])[0]
    .select("event_id", *[f"at_{p}" for p in prep.DATETIME_PARTS], F.round("hour_value", 6).alias("hour_value")),
    "fe_chain": _fe(
        [fe.Interaction("l_quantity", "l_discount", "a"), fe.Ratio("a", "l_tax", "b"), fe.Difference("b", "l_quantity", "c"),
         fe.Square("a", "d"), fe.Log1p("l_discount", "e")],
        ["a", "b", "c", "d", "e"],
    ),
}

_LI = "(SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem)"
_OR = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"
_FIT_LI = f"(SELECT * FROM {_LI} WHERE l_shipdate < TIMESTAMP '{CUT}')"
_FIT_OR = f"(SELECT * FROM {_OR} WHERE o_orderdate < TIMESTAMP '{CUT}')"


def _impute_li(agg):
    return (f"WITH p AS (SELECT {agg}(l_discount) AS v FROM {_FIT_LI}) "
            f"SELECT l_orderkey, l_linenumber, {R('coalesce(l_discount, v)', 6)} AS l_discount FROM {_LI}, p")


def _scale(shift, scale):
    cols = ["l_quantity", "l_extendedprice"]
    params = ", ".join(f"{shift.format(c=c)} AS s_{c}, {scale.format(c=c)} AS k_{c}" for c in cols)
    outs = ", ".join(
        f"{R(f'({c} - s_{c}) / CASE WHEN k_{c} = 0 THEN 1 ELSE k_{c} END', 6)} AS {c}" for c in cols
    )
    return f"WITH p AS (SELECT {params} FROM {_FIT_LI}) SELECT l_orderkey, l_linenumber, {outs} FROM {_LI}, p"


_MODE = f"(SELECT o_orderpriority FROM {_FIT_OR} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
_ONE_HOT = ", ".join(
    f"CASE WHEN o_orderpriority = '{v}' THEN 1.0 ELSE 0.0 END AS \"o_orderpriority_{v}\"" for v in _PRIOS
)
_ORDINAL = " ".join(f"WHEN o_orderpriority = '{v}' THEN {float(i)}" for i, v in enumerate(_PRIOS))

_CHAIN = f"""
WITH p AS (SELECT quantile_cont(l_discount, 0.5) AS med, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                  quantile_cont(l_extendedprice, 0.5) AS me,
                  quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr
           FROM {_FIT_LI})
SELECT {R("CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END", 6)} AS l_returnflag_A,
       {R("CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END", 6)} AS l_returnflag_N,
       {R("CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END", 6)} AS l_returnflag_R,
       {R('(l_quantity - mq) / sq', 6)} AS l_quantity, {R('(l_extendedprice - me) / iqr', 6)} AS l_extendedprice,
       {R('l_tax', 6)} AS l_tax,
       year(l_shipdate) AS l_shipdate_year, month(l_shipdate) AS l_shipdate_month, day(l_shipdate) AS l_shipdate_day,
       dayofweek(l_shipdate) + 1 AS l_shipdate_dayofweek, hour(l_shipdate) AS l_shipdate_hour,
       {R('coalesce(l_discount, med)', 6)} AS l_discount, l_orderkey, l_linenumber
FROM {_LI}, p
"""


def _fe_sql(exprs: dict) -> str:
    outs = ", ".join(f"{R(e, 6)} AS {n}" for n, e in exprs.items())
    return f"SELECT l_orderkey, l_linenumber, {outs} FROM lineitem"


_LOG = "CASE WHEN {x} = -1 THEN CAST('-inf' AS DOUBLE) ELSE ln(1 + {x}) END"
_A = "(l_quantity * l_discount)"
_B = f"(CASE WHEN l_tax = 0 THEN NULL ELSE {_A} / l_tax END)"
_C = f"({_B} - l_quantity)"

_WIDE = """(SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_orderkey % 3 = 0 THEN 'common'
  WHEN l_orderkey % 11 <> 1 THEN concat_ws('/', l_partkey % 5000, l_orderkey % 97, l_linenumber) END AS place FROM lineitem)"""
_CODES = f"(SELECT place, row_number() OVER (ORDER BY place) - 1 AS code FROM (SELECT DISTINCT place FROM {_WIDE} WHERE l_shipdate < TIMESTAMP '{CUT}' AND place IS NOT NULL))"

ORACLES = {
    "one_hot_wide": f"""WITH codes AS {_CODES}, k AS (SELECT count(*) AS k FROM codes),
      m AS (SELECT count(*) > 0 AS missing FROM {_WIDE} WHERE l_shipdate < TIMESTAMP '{CUT}' AND place IS NULL)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN w.place IS NULL AND missing THEN k ELSE code END AS INTEGER) AS place,
      CAST(k + CAST(missing AS INT) AS INTEGER) AS size FROM {_WIDE} w LEFT JOIN codes USING (place), k, m""",
    "ordinal_wide": f"""WITH codes AS {_CODES} SELECT l_orderkey, l_linenumber,
      CASE WHEN w.place IS NOT NULL THEN coalesce(CAST(code AS DOUBLE), -1.0) END AS place FROM {_WIDE} w LEFT JOIN codes USING (place)""",
    "impute_mean": _impute_li("avg"),
    "impute_median": _impute_li("median"),
    "impute_mode": f"SELECT o_orderkey, coalesce(o_orderpriority, {_MODE}) AS o_orderpriority FROM {_OR}",
    "impute_constant": f"SELECT o_orderkey, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM {_OR}",
    "one_hot": f"SELECT o_orderkey, {_ONE_HOT}, CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0.0 END AS o_orderpriority_nan FROM {_OR}",
    "ordinal_encode": f"SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN NULL {_ORDINAL} ELSE -1.0 END AS o_orderpriority FROM {_OR}",
    "scale_standard": _scale("avg({c})", "stddev_pop({c})"),
    "scale_minmax": _scale("min({c})", "max({c}) - min({c})"),
    "scale_robust": _scale("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "datetime_extract": "SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, "
    "dayofweek(ts) + 1 AS ts_dayofweek, hour(ts) AS ts_hour FROM events",
    "fe_datetime": "SELECT event_id, year(ts) AS at_year, month(ts) AS at_month, day(ts) AS at_day, dayofweek(ts) + 1 AS at_dayofweek, "
    f"hour(ts) AS at_hour, {R('hour(ts) * value', 6)} AS hour_value FROM events",
    "prep_drop": "SELECT * EXCLUDE (l_tax, l_linestatus) FROM lineitem",
    "prep_passthrough": "SELECT * FROM lineitem",
    "prep_chain": _CHAIN,
    "fe_interaction": _fe_sql({"qty_x_disc": "l_quantity * l_discount"}),
    "fe_ratio": _fe_sql({"price_per_disc": "CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END"}),
    "fe_difference": _fe_sql({"price_minus_tax": "l_extendedprice - l_tax"}),
    "fe_log1p": _fe_sql({"log_disc": _LOG.format(x="(l_discount - 1.0)")}),
    "fe_square": _fe_sql({"qty_sq": "l_quantity * l_quantity"}),
    "fe_chain": _fe_sql({"a": _A, "b": _B, "c": _C, "d": f"{_A} * {_A}", "e": _LOG.format(x="l_discount")}),
}
