"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests.

Each distinct (host, path) is expanded into its host suffixes (as many labels as a rule has at
most) times its path prefixes (of the lengths that rules have); the expressions meet the rules
in an equi-join on the first 32 bits of their SHA-256, and the full digest confirms a match.
The longest matching rule wins (of two equally long ones, the one with the longer host). All
of it is DataFrame functions. Work per URL is bounded by the rule set; one URL that a third of
the rows share is expanded once.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
gets the default verdict; a rule's host ``""`` is not allowed; equal rules with different
verdicts: block wins; every input row, repeated or not, gives one output row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]

#: The base rules.
RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` of each row, and ``host``, ``path``, ``rule``, ``verdict``.

    ``rules``: (host, path, verdict); a rule fits its host and all subdomains where the url's
    path starts with the rule's. Rows that no rule fits get a null rule and ``default``.
    """
    if any(not host for host, _, _ in rules):
        raise ValueError("a rule needs a host")
    spark = pages.sparkSession
    table = spark.createDataFrame(list(rules), "r_host string, r_path string, r_verdict string").select(
        F.concat("r_host", "r_path").alias("rule"),
        F.length("r_host").alias("n_host"),
        "r_verdict",
        F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256).alias("r_digest"),
    )
    table = table.withColumn("prefix", F.substring("r_digest", 1, 8))
    labels = max((host.count(".") + 1 for host, _, _ in rules), default=0)
    lengths = sorted({len(path) for _, path, _ in rules})

    rows = pages.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    suffixes = F.array(*[F.substring_index("host", ".", -n) for n in range(1, labels + 1)])
    fitting = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    expressions = (
        rows.select("host", "path")
        .distinct()
        .where("host <> ''")
        .withColumn("suffix", F.explode(F.array_distinct(suffixes)))
        .withColumn("start", F.explode(F.array_compact(F.array(*fitting))))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "start"), 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    matches = expressions.join(table, "prefix").where("digest = r_digest")
    best = matches.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "n_host", F.col("r_verdict") == "block", "rule", "r_verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judge_sql(rules: Sequence[Rule] = RULES, default: str = DEFAULT) -> str:
    """DuckDB SQL with the rows of ``judge`` over ``pages``."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    WITH rules(h, p, v) AS (VALUES {values}),
    parts AS (
      SELECT row_number() OVER () AS r, page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    split AS (
      SELECT r, page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM parts),
    best AS (
      SELECT r, max_by(h || p, length(h || p) * 10000 + length(h)) AS rule, max_by(v, length(h || p) * 10000 + length(h)) AS verdict
      FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict
    FROM split LEFT JOIN best USING (r)
    """
