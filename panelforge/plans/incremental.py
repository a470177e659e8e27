"""Queries of incremental work: factors refreshed after late and new lines, configurations compared, load windows decided.

The twin of the refresh is the full computation; the other twins are set operations written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans.expression import Plan
from panelforge.plans.reach import Refresh
from panelforge.sources import registry
from panelforge.sources.panel import PANEL_SQL, dense, read
from panelforge.sources.stage import staged

FORMULAS = {
    "inc_reversal": "-d(C,3)", "inc_range": "(ts_max(H,6)-ts_min(L,6))/C", "inc_rank": "rank(sum(R,4))", "inc_corr": "corr(rank(C),rank(V),5)",
    "inc_decay": "decay(vwap,4)-ma(C,8)", "inc_neutral": "indneu(lag(C,2),L2)", "inc_ema": "ema(C,5)", "inc_carried": "ffill(V)", "inc_cap": "log(cap)",
}
KNOWN = "l_shipdate < DATE '2001-09-01' AND NOT (l_shipdate >= DATE '2001-03-01' AND l_linenumber = 7)"


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors stored from what was delivered at first (shipped before September 2001, seventh lines of an order missing for half a year), refreshed to the whole table."""
    plan = Plan(FORMULAS)
    first = dense(spark, sf_dir, KNOWN)
    stored = staged(plan.long(first))
    return Refresh(plan, first, dense(spark, sf_dir)).run(stored)


def _config(spark: SparkSession, sf_dir: str, when: str) -> DataFrame:
    """A part is a dataset, its lines' numbers are its fields, their states its members; cheap parts have tables of their own."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") <= 15, "side").otherwise("panel").alias("kind"))
    rows = read(spark, sf_dir, "lineitem").where(when).groupBy("l_partkey").agg(
        F.collect_set(F.concat(F.lit("line"), "l_linenumber")).alias("fields"), F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("members"), F.max(F.col("l_quantity").cast("int").cast("string")).alias("q"),
    )
    return rows.join(part, "l_partkey").select(F.concat(F.lit("p"), "l_partkey").alias("name"), "kind", "fields", "members", F.create_map(F.lit("largest"), "q", F.lit("token"), F.lit(when)).alias("settings"))


def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registry.diff(_config(spark, sf_dir, "l_shipdate < DATE '1998-07-01'"), _config(spark, sf_dir, "l_shipdate >= DATE '1998-07-01'"))
    return out.select("name", "action", F.concat_ws(",", "fields").alias("fields"), F.concat_ws(",", "members").alias("members"))


def load_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as datasets: their segment gives the policy, debts ask for a full load, the last order is the watermark."""
    policy = F.element_at(F.create_map(*(F.lit(v) for kv in POLICIES.items() for v in kv)), F.col("c_mktsegment"))
    sets = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), policy.alias("policy"), F.when(F.col("c_acctbal") < 0, "full").alias("asked"))
    marks = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderdate").cast("date").alias("last"))
    return registry.windows(sets, marks)


POLICIES = {"AUTOMOBILE": "static", "BUILDING": "resumed", "FURNITURE": "announced", "HOUSEHOLD": "listed", "MACHINERY": "always"}
_SIDE = """SELECT 'p' || l_partkey AS name, l_partkey, 'line' || l_linenumber AS field, l_returnflag || l_linestatus AS member, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem WHERE"""
_DIFF = f"""WITH a AS ({_SIDE} l_shipdate < DATE '1998-07-01'), b AS ({_SIDE} l_shipdate >= DATE '1998-07-01'),
  w AS (SELECT name, side, string_agg(DISTINCT field, ',' ORDER BY field) AS fields, string_agg(DISTINCT member, ',' ORDER BY member) AS members, max(q) AS q
    FROM (SELECT *, 'a' AS side FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY name, side),
  k AS (SELECT 'p' || p_partkey AS name, p_size <= 15 AS own FROM part),
  morefields AS (SELECT name, string_agg(field, ',' ORDER BY field) AS s FROM (SELECT name, field FROM b EXCEPT SELECT name, field FROM a) GROUP BY name),
  lessfields AS (SELECT name, string_agg(field, ',' ORDER BY field) AS s FROM (SELECT name, field FROM a EXCEPT SELECT name, field FROM b) GROUP BY name),
  moremembers AS (SELECT name, string_agg(member, ',' ORDER BY member) AS s FROM (SELECT name, member FROM b EXCEPT SELECT name, member FROM a) GROUP BY name),
  p AS (SELECT k.name, own, o.fields AS fo, n.fields AS fn, o.members AS mo, n.members AS mn, o.q AS qo, n.q AS qn, f.s AS mf, l.s AS lf, m.s AS mm
    FROM k LEFT JOIN w o ON o.name = k.name AND o.side = 'a' LEFT JOIN w n ON n.name = k.name AND n.side = 'b'
    LEFT JOIN morefields f ON f.name = k.name LEFT JOIN lessfields l ON l.name = k.name LEFT JOIN moremembers m ON m.name = k.name)
  SELECT name, 'install' AS action, fn AS fields, mn AS members FROM p WHERE fn IS NOT NULL AND (fo IS NULL OR (own AND (fo <> fn OR mo <> mn OR qo <> qn)) OR (NOT own AND mf IS NOT NULL AND mm IS NOT NULL))
  UNION ALL SELECT name, 'install', mf, mn FROM p WHERE fn IS NOT NULL AND fo IS NOT NULL AND NOT own AND mf IS NOT NULL AND mm IS NULL
  UNION ALL SELECT name, 'install', fn, mm FROM p WHERE fn IS NOT NULL AND fo IS NOT NULL AND NOT own AND mf IS NULL AND mm IS NOT NULL
  UNION ALL SELECT name, 'remove', fo, mo FROM p WHERE fn IS NULL AND fo IS NOT NULL
  UNION ALL SELECT name, 'drop_fields', lf, '' FROM p WHERE fn IS NOT NULL AND fo IS NOT NULL AND NOT own AND lf IS NOT NULL"""
_WINDOWS = """SELECT CAST(c_custkey AS VARCHAR) AS name,
    CASE WHEN d IS NULL OR c_mktsegment = 'MACHINERY' THEN 'full' WHEN c_mktsegment = 'BUILDING' THEN 'incremental' WHEN c_acctbal < 0 THEN 'full' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'skip' ELSE 'incremental' END AS mode,
    CASE WHEN c_mktsegment = 'BUILDING' THEN d WHEN c_mktsegment = 'FURNITURE' AND NOT coalesce(c_acctbal < 0, false) THEN d - 3 END AS start
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
QUERIES = {"incremental_factors": refreshed, "registry_diff": config_diff, "registry_windows": load_windows}
ORACLES = {"incremental_factors": Plan(FORMULAS).long_sql(PANEL_SQL), "registry_diff": _DIFF, "registry_windows": _WINDOWS}
