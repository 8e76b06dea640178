"""Registered queries for feature selection (L1-L4, L6), metrics (X1-X7) and comparison
(G1, G2). Predictions come from fixed rules over the test tables, so every metric has an
SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, evaluate, prep, select
from .profiling import T
from .sqlgen import R

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_qty2", "l_const"]


def _li_num(s, sf):
    return T(s, sf, "lineitem").withColumn("l_qty2", F.col("l_quantity") * 2.0).withColumn("l_const", F.lit(1.0))


def _report(rep, d=6):
    return rep.select("column_name", "position", F.round("score", d).alias("score"), "rank", "selected")


def _fs_variance(s, sf):
    _, rep = select.select_features(_li_num(s, sf), _NUM, "l_orderkey", "variance")
    return _report(rep, 4)


def _fs_corr_matrix(s, sf):
    t = select.correlation_table(_li_num(s, sf), _NUM[:5])
    return t.select("column_a", "column_b", F.round("abs_corr", 6).alias("abs_corr"))


def _fs_corr(s, sf):
    _, rep = select.select_features(_li_num(s, sf), _NUM[:5], "l_orderkey", "correlation")
    return _report(rep)


def _fs_mi(s, sf):
    o = T(s, sf, "orders")
    _, rep = select.select_features(o, ["o_totalprice", "o_orderpriority", "o_custkey"], "o_orderstatus", "mutual_info",
                                    max_features=2)
    return _report(rep)


def _fs_chain(s, sf):
    li = T(s, sf, "lineitem").select("l_quantity", "l_returnflag", "l_tax", "l_linestatus")
    model = prep.PrepPipeline([prep.OneHot(["l_returnflag"])]).fit(li)
    out = model.transform(li)
    lineage = {"l_returnflag": [c for c in out.columns if c.startswith("l_returnflag_")]}
    _, rep = select.select_features(out, ["l_quantity", "l_returnflag", "l_tax"], "l_linestatus", "none", lineage=lineage)
    return _report(rep)


_FLAG_RULE = "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END"
_STATUS_RULE = "CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END"


def _preds3(s, sf):
    return T(s, sf, "lineitem").select(F.lit("rule_qty").alias("model_id"), F.col("l_returnflag").alias("label"),
                                       F.expr(_FLAG_RULE).alias("prediction"))


def _preds2(s, sf):
    return T(s, sf, "lineitem").select(F.lit("rule_qty").alias("model_id"), F.col("l_linestatus").alias("label"),
                                       F.expr(_STATUS_RULE).alias("prediction"))


def _cls_metrics(preds):
    def run(s, sf):
        m = evaluate.classification_metrics(preds(s, sf), model="model_id")
        return m.select("model_id", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "average")
    return run


def _auc(s, sf):
    o = T(s, sf, "orders").select(F.lit("price").alias("model_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                                  (F.col("o_totalprice") / 1e6).alias("score"))
    return evaluate.roc_auc(o, model="model_id").select("model_id", F.round("roc_auc", 6).alias("roc_auc"))


def _auc_ovr(s, sf):
    o = T(s, sf, "orders").select(
        F.lit("rule").alias("model_id"), F.col("o_orderstatus").alias("label"),
        F.array(F.col("o_totalprice") / 1e6, F.year("o_orderdate") / 3000.0, 1.0 - F.col("o_totalprice") / 1e6).alias("p"))
    return evaluate.roc_auc_ovr(o, probs="p", classes=["F", "O", "P"], model="model_id").select(
        "model_id", F.round("roc_auc", 6).alias("roc_auc"))


_REG_RULES = [("qty_x_2000", "l_quantity * 2000.0"), ("qty_x_2100", "l_quantity * 2100.0"),
              ("disc_rule", "l_extendedprice * (1 - l_discount)")]


def _reg_preds(s, sf):
    li = T(s, sf, "lineitem")
    out = None
    for i, (name, rule) in enumerate(_REG_RULES):
        p = li.select(F.lit(name).alias("model_id"), F.lit(i).alias("position"), F.col("l_extendedprice").alias("label"),
                      F.expr(rule).alias("prediction"))
        out = p if out is None else out.unionByName(p)
    return out


def _reg_long(s, sf):
    preds = _reg_preds(s, sf)
    pos = preds.select("model_id", "position").distinct()
    wide = evaluate.regression_metrics(preds, model="model_id").join(pos, "model_id")
    long = evaluate.metrics_long(wide, ["model_id", "position"], ["mae", "mse", "rmse", "r2"])
    return long.select("model_id", "position", "metric", F.round("value", 4).alias("value"))


def _regression(s, sf):
    m = evaluate.regression_metrics(_reg_preds(s, sf).where("position = 0"), model="model_id")
    return m.select("model_id", *[F.round(c, 4).alias(c) for c in ("mae", "mse", "rmse", "r2")])


def _champion(s, sf):
    long = _reg_long(s, sf).where("metric = 'rmse'")
    keys = [F.lit("lineitem").alias("dataset_id"), F.lit("price").alias("problem_id"), F.lit("l_extendedprice").alias("target")]
    a = long.where("position = 0").select(*keys, "metric", "value")
    b = long.where("position = 2").select(*keys, "metric", "value")
    out = compare.compare_runs(a, b)
    return out.select("dataset_id", "problem_id", "target", "metric", "champion_value", "challenger_value",
                      F.round("difference", 4).alias("difference"), "winner", "improved",
                      F.round("relative_improvement", 6).alias("relative_improvement"))


def _roc_curve(s, sf):
    o = T(s, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"),
                                  F.col("o_totalprice").alias("score"))
    c = evaluate.roc_curve(o)
    return c.select(F.round("threshold", 4).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def _prf_numbers(s, sf):
    """Labels 9 and 10: the positive one is the larger number, not the larger text."""
    li = T(s, sf, "lineitem").select(F.when(F.col("l_quantity") > 25, 10).otherwise(9).alias("label"),
                                     F.when(F.col("l_extendedprice") > 30000, 10).otherwise(9).alias("prediction"))
    return evaluate.classification_metrics(li).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "average")


QUERIES = {
    "fs_variance": _fs_variance,
    "fs_correlation_matrix": _fs_corr_matrix,
    "fs_correlation": _fs_corr,
    "fs_mutual_info": _fs_mi,
    "fs_chain": _fs_chain,
    "confusion_matrix": lambda s, sf: evaluate.confusion(_preds3(s, sf), model="model_id"),
    "metric_accuracy": lambda s, sf: _cls_metrics(_preds3)(s, sf).select("model_id", "accuracy"),
    "metric_prf_binary": _cls_metrics(_preds2),
    "metric_prf_macro": _cls_metrics(_preds3),
    "metric_prf_numbers": _prf_numbers,
    "class_report": lambda s, sf: evaluate.class_report(_preds3(s, sf), model="model_id").select(
        "model_id", "row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"),
    "metric_roc_auc": _auc,
    "metric_roc_auc_ovr": _auc_ovr,
    "roc_curve": _roc_curve,
    "metric_regression": _regression,
    "leaderboard": lambda s, sf: compare.leaderboard(_reg_long(s, sf), "rmse"),
    "best_model": lambda s, sf: compare.best_model(_reg_long(s, sf), "rmse"),
    "champion_compare": _champion,
}

# ------------------------------------------------------------------------------ oracles

_LI_NUM = "(SELECT *, l_quantity * 2.0 AS l_qty2, 1.0 AS l_const FROM lineitem)"


def _variance_sql():
    parts = [f"SELECT '{c}' AS column_name, {i} AS position, {R(f'var_pop({c})', 4)} AS score, CAST(NULL AS INTEGER) AS rank, "
             f"var_pop({c}) > 0.0 AS selected FROM {_LI_NUM}" for i, c in enumerate(_NUM)]
    return " UNION ALL ".join(parts)


def _corr_expr(a, b):
    return f"abs(corr({a}, {b}))" if a != b else "1.0"


def _corr_matrix_sql():
    cols = _NUM[:5]
    parts = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, {R(_corr_expr(a, b), 6)} AS abs_corr"
             + (f" FROM {_LI_NUM}" if a != b else "") for a in cols for b in cols]
    return " UNION ALL ".join(parts)


def _corr_select_sql(t=0.95):
    cols = _NUM[:5]
    n = len(cols)
    cs = ", ".join(f"abs(corr({cols[i]}, {cols[j]})) AS c{i}_{j}" for i in range(n) for j in range(i + 1, n))
    sql = f"WITH s0 AS (SELECT {cs}, false AS r0 FROM {_LI_NUM})"
    for j in range(1, n):
        cond = " OR ".join(f"(NOT r{i} AND coalesce(c{i}_{j} > {t}, false))" for i in range(j))
        sql += f", s{j} AS (SELECT *, ({cond}) AS r{j} FROM s{j - 1})"
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS INTEGER) AS rank, "
        f"NOT r{i} AS selected FROM s{n - 1}" for i, c in enumerate(cols))
    return sql + " " + rows


def _mi_sql():
    cuts = ", ".join(f"quantile_cont(o_totalprice, {j / 10}) AS t{j}, quantile_cont(CAST(o_custkey AS DOUBLE), {j / 10}) AS k{j}"
                     for j in range(1, 10))
    tb = " + ".join(f"CASE WHEN o_totalprice > t{j} THEN 1 ELSE 0 END" for j in range(1, 10))
    kb = " + ".join(f"CASE WHEN CAST(o_custkey AS DOUBLE) > k{j} THEN 1 ELSE 0 END" for j in range(1, 10))
    return f"""
WITH q AS (SELECT {cuts} FROM orders),
long AS (SELECT 0 AS g, CAST({tb} AS VARCHAR) AS b, o_orderstatus AS y FROM orders, q
         UNION ALL SELECT 1, o_orderpriority, o_orderstatus FROM orders
         UNION ALL SELECT 2, CAST({kb} AS VARCHAR), o_orderstatus FROM orders, q),
c AS (SELECT g, b, y, count(*) AS n FROM long GROUP BY ALL),
px AS (SELECT g, b, sum(n) AS nx FROM c GROUP BY ALL), py AS (SELECT g, y, sum(n) AS ny FROM c GROUP BY ALL),
nt AS (SELECT g, sum(n) AS nt FROM c GROUP BY ALL),
mi AS (SELECT c.g, greatest(sum(n / nt * ln(n * nt / (nx * ny))), 0.0) AS score
       FROM c JOIN px USING (g, b) JOIN py USING (g, y) JOIN nt USING (g) GROUP BY c.g),
named AS (SELECT CASE g WHEN 0 THEN 'o_totalprice' WHEN 1 THEN 'o_orderpriority' ELSE 'o_custkey' END AS column_name,
                 CAST(g AS INTEGER) AS position, score FROM mi),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, column_name) AS INTEGER) AS rank FROM named)
SELECT column_name, position, {R('score', 6)} AS score, rank, rank <= 2 AS selected FROM ranked
"""


_FS_CHAIN = """
WITH f AS (SELECT DISTINCT l_returnflag FROM lineitem),
r AS (SELECT 'l_returnflag_' || l_returnflag AS column_name, CAST(row_number() OVER (ORDER BY l_returnflag) AS INTEGER) AS position FROM f)
SELECT 'l_quantity' AS column_name, 0 AS position, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS INTEGER) AS rank, true AS selected
UNION ALL SELECT column_name, position, NULL, NULL, true FROM r
UNION ALL SELECT 'l_tax', (SELECT count(*) + 1 FROM f), NULL, NULL, true
"""

_P3 = f"(SELECT 'rule_qty' AS model_id, l_returnflag AS label, {_FLAG_RULE} AS prediction FROM lineitem)"
_P2 = f"(SELECT 'rule_qty' AS model_id, l_linestatus AS label, {_STATUS_RULE} AS prediction FROM lineitem)"


def _per_class(p):
    return f"""
classes AS (SELECT DISTINCT model_id, label AS cls FROM {p} UNION SELECT DISTINCT model_id, prediction FROM {p}),
pc AS (SELECT c.model_id, c.cls,
         (SELECT count(*) FROM {p} x WHERE x.label = c.cls AND x.prediction = c.cls) AS tp,
         (SELECT count(*) FROM {p} x WHERE x.prediction = c.cls) AS n_pred,
         (SELECT count(*) FROM {p} x WHERE x.label = c.cls) AS n_true FROM classes c),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS prec,
             CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS rec FROM pc),
m2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
"""


def _cls_sql(p, cols=("accuracy", "precision", "recall", "f1", "average")):
    body = f"""WITH {_per_class(p)},
agg AS (SELECT model_id, sum(tp) / sum(n_true) AS accuracy, count(*) FILTER (WHERE n_true > 0) AS n_labels,
          max(cls) FILTER (WHERE n_true > 0) AS largest, avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf FROM m2 GROUP BY model_id),
res AS (SELECT a.model_id, a.accuracy,
          CASE WHEN n_labels > 2 THEN mp ELSE coalesce((SELECT prec FROM m2 WHERE m2.cls = a.largest), 0.0) END AS precision,
          CASE WHEN n_labels > 2 THEN mr ELSE coalesce((SELECT rec FROM m2 WHERE m2.cls = a.largest), 0.0) END AS recall,
          CASE WHEN n_labels > 2 THEN mf ELSE coalesce((SELECT f1 FROM m2 WHERE m2.cls = a.largest), 0.0) END AS f1,
          CASE WHEN n_labels > 2 THEN 'macro' ELSE 'binary' END AS average FROM agg a)
SELECT model_id"""
    for c in cols:
        body += f", {R(c, 6)} AS {c}" if c != "average" else ", average"
    return body + " FROM res"


def _class_report_sql():
    return f"""WITH {_per_class(_P3)},
t AS (SELECT model_id, sum(tp) / sum(n_true) AS acc, sum(n_true) AS n, avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf,
         sum(prec * n_true) / sum(n_true) AS wp, sum(rec * n_true) / sum(n_true) AS wr, sum(f1 * n_true) / sum(n_true) AS wf
      FROM m2 GROUP BY model_id)
SELECT model_id, cls AS row, {R('prec', 6)} AS precision, {R('rec', 6)} AS recall, {R('f1', 6)} AS f1, n_true AS support FROM m2
UNION ALL SELECT model_id, 'accuracy', {R('acc', 6)}, {R('acc', 6)}, {R('acc', 6)}, n FROM t
UNION ALL SELECT model_id, 'macro avg', {R('mp', 6)}, {R('mr', 6)}, {R('mf', 6)}, n FROM t
UNION ALL SELECT model_id, 'weighted avg', {R('wp', 6)}, {R('wr', 6)}, {R('wf', 6)}, n FROM t
"""


def _auc_sql(src):
    """Tie-aware AUC over (g, pos, score) rows."""
    return f"""
s AS (SELECT g, score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM {src} GROUP BY ALL),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
auc AS (SELECT g, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) END AS auc FROM c GROUP BY g)
"""


_AUC = ("WITH src AS (SELECT 'price' AS g, o_orderstatus = 'F' AS pos, o_totalprice / 1e6 AS score FROM orders), "
        + _auc_sql("src") + f"SELECT g AS model_id, {R('coalesce(auc, 0.0)', 6)} AS roc_auc FROM auc")

_AUC_OVR = (
    "WITH src AS (SELECT 'F' AS g, o_orderstatus = 'F' AS pos, o_totalprice / 1e6 AS score FROM orders "
    "UNION ALL SELECT 'O', o_orderstatus = 'O', year(o_orderdate) / 3000.0 FROM orders "
    "UNION ALL SELECT 'P', o_orderstatus = 'P', 1.0 - o_totalprice / 1e6 FROM orders), "
    + _auc_sql("src") + f"SELECT 'rule' AS model_id, {R('coalesce(avg(auc), 0.0)', 6)} AS roc_auc FROM auc"
)


def _reg_sql_rows():
    parts = [f"SELECT '{n}' AS model_id, {i} AS position, l_extendedprice AS y, {rule} AS p FROM lineitem"
             for i, (n, rule) in enumerate(_REG_RULES)]
    return "(" + " UNION ALL ".join(parts) + ")"


_REG_WIDE = f"""
w AS (SELECT model_id, position, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse,
      CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))
           WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END AS r2
      FROM {_reg_sql_rows()} GROUP BY model_id, position)
"""
_REG_LONG = (_REG_WIDE + ", long AS (SELECT model_id, position, 'mae' AS metric, mae AS value FROM w UNION ALL "
             "SELECT model_id, position, 'mse', mse FROM w UNION ALL SELECT model_id, position, 'rmse', rmse FROM w UNION ALL "
             "SELECT model_id, position, 'r2', r2 FROM w)")

ORACLES = {
    "fs_variance": _variance_sql(),
    "fs_correlation_matrix": _corr_matrix_sql(),
    "fs_correlation": _corr_select_sql(),
    "fs_mutual_info": _mi_sql(),
    "fs_chain": _FS_CHAIN,
    "confusion_matrix": f"""WITH c AS (SELECT DISTINCT label AS v FROM {_P3} UNION SELECT DISTINCT prediction FROM {_P3})
SELECT 'rule_qty' AS model_id, a.v AS label, b.v AS prediction,
       (SELECT count(*) FROM {_P3} x WHERE x.label = a.v AND x.prediction = b.v) AS n FROM c a, c b""",
    "metric_accuracy": _cls_sql(_P3, ("accuracy",)),
    "metric_prf_binary": _cls_sql(_P2),
    "metric_prf_macro": _cls_sql(_P3),
    "metric_prf_numbers": "WITH c AS (SELECT l_quantity > 25 AS y, l_extendedprice > 30000 AS p FROM lineitem), "
    "n AS (SELECT count(*) AS n, count(*) FILTER (y = p) AS ok, count(*) FILTER (y AND p) AS tp, count(*) FILTER (p) AS np, count(*) FILTER (y) AS ny FROM c) "
    f"SELECT {R('ok / n', 6)} AS accuracy, {R('tp / np', 6)} AS precision, {R('tp / ny', 6)} AS recall, {R('2.0 * tp / (np + ny)', 6)} AS f1, 'binary' AS average FROM n",
    "class_report": _class_report_sql(),
    "metric_roc_auc": _AUC,
    "metric_roc_auc_ovr": _AUC_OVR,
    "roc_curve": f"""WITH s AS (SELECT o_totalprice AS score, count(*) FILTER (WHERE o_orderstatus = 'F') AS p,
                      count(*) FILTER (WHERE o_orderstatus <> 'F') AS n FROM orders GROUP BY 1),
c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM s)
SELECT {R('score', 4)} AS threshold, {R('fp / (SELECT sum(n) FROM s)', 6)} AS fpr, {R('tp / (SELECT sum(p) FROM s)', 6)} AS tpr FROM c""",
    "metric_regression": "WITH " + _REG_WIDE + " SELECT model_id, " + ", ".join(f"{R(c, 4)} AS {c}" for c in ("mae", "mse", "rmse", "r2"))
    + " FROM w WHERE position = 0",
    "leaderboard": "WITH " + _REG_LONG + f", r AS (SELECT model_id, position, metric, {R('value', 4)} AS value FROM long WHERE metric = 'rmse') "
    "SELECT *, CAST(row_number() OVER (ORDER BY value, position) AS INTEGER) AS rank FROM r",
    "best_model": "WITH " + _REG_LONG + f", r AS (SELECT model_id, position, metric, {R('value', 4)} AS value FROM long WHERE metric = 'rmse') "
    "SELECT metric, model_id, position, value FROM r ORDER BY value, position LIMIT 1",
    "champion_compare": "WITH " + _REG_LONG + f", r AS (SELECT position, {R('value', 4)} AS value FROM long WHERE metric = 'rmse'), "
    "a AS (SELECT value AS cv FROM r WHERE position = 0), b AS (SELECT value AS nv FROM r WHERE position = 2) "
    "SELECT 'lineitem' AS dataset_id, 'price' AS problem_id, 'l_extendedprice' AS target, 'rmse' AS metric, cv AS champion_value, "
    f"nv AS challenger_value, {R('nv - cv', 4)} AS difference, CASE WHEN abs(nv - cv) < 1e-9 THEN 'tie' WHEN nv < cv THEN 'challenger' "
    "ELSE 'champion' END AS winner, (abs(nv - cv) >= 1e-9 AND nv < cv) AS improved, "
    f"CASE WHEN cv = 0 THEN 0.0 ELSE {R('(cv - nv) / cv', 6)} END AS relative_improvement FROM a, b",
}
