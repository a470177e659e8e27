"""Attribution tree of the ten best symbols by momentum against the capitalisation-weighted panel: region, nation, symbol.

The twin uses the closed form of a subtotal, not the effects of the levels below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import attribution
from panelforge.plans.evaluation import _PLAN, R, frame_sql
from panelforge.sources.panel import dense

LEVELS, N = ["l1", "l2", "symbol"], 10


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, l1, l2, symbol, wp, wb, r): weights of a session, a tenth of the next session's return (the supplied prices jump)."""
    p = _PLAN.columns(dense(spark, sf_dir)).where("l2 is not null")
    p = p.withColumn("r", F.try_divide(F.lead("close").over(Window.partitionBy("symbol").orderBy("t")), F.col("close")) / 10 - 0.1).where("mv is not null and r is not null")
    day = Window.partitionBy("t")
    k = F.row_number().over(day.orderBy(F.desc_nulls_last(F.round("mom_5", 9)), "symbol"))
    picked = F.when((k <= N) & F.col("mom_5").isNotNull(), 1.0).otherwise(0.0)
    p = p.withColumn("pick", picked).withColumn("many", F.sum("pick").over(day)).where("many > 0")
    return p.select("t", *LEVELS, (F.col("pick") / F.col("many")).alias("wp"), (F.col("mv") / F.sum("mv").over(day)).alias("wb"), "r")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attribution.tree(positions(spark, sf_dir), LEVELS)
    return out.select("level", *LEVELS, F.expr(R("subtotal")).alias("subtotal"), (F.abs("residual") < 1e-10).alias("adds_up"))


def _level(k: int) -> str:
    """Subtotals of level k: what the node's leaves earned, less its parent's benchmark return on its weight, less the neutral part."""
    keys, up = ", ".join(["t", *LEVELS[:k]]), ", ".join(["t", *LEVELS[: k - 1]])
    own = "sum(wb * r) / nullif(sum(wb), 0)"
    names = ", ".join([*LEVELS[:k], *(f"CAST(NULL AS BIGINT) AS {c}" for c in LEVELS[k:])])
    return f"""SELECT {k} AS level, {names}, sum((earned - wp * rp - wb * wpp / wbp * (rb - rp)) * factor) AS subtotal FROM (
      SELECT {keys}, sum(wp * r) AS earned, sum(wp) AS wp, sum(wb) AS wb, {own} AS rb FROM ps GROUP BY {keys}) n JOIN (SELECT {up}, sum(wp) AS wpp, sum(wb) AS wbp, {own} AS rp FROM ps GROUP BY {up}) u USING ({up}) JOIN fc USING (t) GROUP BY {", ".join(LEVELS[:k])}"""


_SQL = f"""WITH {frame_sql()}, x AS (SELECT symbol, t, l1, l2, mv, f, (lead(close) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0)) / 10 - 0.1 AS r FROM ev WHERE factor = 'mom_5'),
  y AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(f, 9) DESC NULLS LAST, symbol) AS k FROM x WHERE mv IS NOT NULL AND r IS NOT NULL AND l2 IS NOT NULL),
  v AS (SELECT *, CASE WHEN k <= {N} AND f IS NOT NULL THEN 1e0 ELSE 0e0 END AS pick FROM y),
  ps AS (SELECT t, l1, l2, symbol, pick / sum(pick) OVER (PARTITION BY t) AS wp, mv / sum(mv) OVER (PARTITION BY t) AS wb, r FROM v QUALIFY sum(pick) OVER (PARTITION BY t) > 0),
  dr AS (SELECT t, sum(wp * r) AS p, sum(wb * r) AS b FROM ps GROUP BY t), al AS (SELECT exp(sum(ln(1 + p))) - 1 AS p, exp(sum(ln(1 + b))) - 1 AS b FROM dr),
  fc AS (SELECT t, (ln(1 + dr.p) - ln(1 + dr.b)) / (dr.p - dr.b) * (al.p - al.b) / (ln(1 + al.p) - ln(1 + al.b)) AS factor FROM dr, al),
  nd AS (SELECT 0 AS level, CAST(NULL AS BIGINT) AS l1, CAST(NULL AS BIGINT) AS l2, CAST(NULL AS BIGINT) AS symbol, p - b AS subtotal FROM al UNION ALL {_level(1)} UNION ALL {_level(2)} UNION ALL {_level(3)})
  SELECT level, l1, l2, symbol, {R('subtotal')} AS subtotal, TRUE AS adds_up FROM nd"""
QUERIES = {"attr_tree": tree}
ORACLES = {"attr_tree": _SQL}
