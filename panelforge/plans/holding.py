"""Rotation with holding rules over the panel: one strategy a region.  The DuckDB twins walk the sessions by recursion, for one holding."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import holding
from panelforge.operators import rotation as ops
from panelforge.plans.evaluation import R
from panelforge.plans.rotation import _PASS, _POINTS, FIT, FLOOR, scores
from panelforge.sources.panel import PANEL_SQL, dense
from panelforge.sources.stage import discard, staged

# monthly bars: shorter holding times, a wider stop
RULES = holding.Rules(least_hold=3, stop=0.85, defence=2, weak_score=0.5, longest=12, depth=10)
WHOLE = replace(RULES, depth=None)  # a holding stays at any place
SAVED = 60  # session up to which the first of two runs goes


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sessions, written once; a region's defensive asset is its first symbol."""
    p = staged(dense(spark, sf_dir).where("l1 is not null").select("symbol", "trade_date", "t", "open", "close", "vol", "l1"))
    pool = p.select("symbol", F.col("l1").cast("string").alias("strategy")).distinct()
    d = scores(p).join(ops.filters(p, floor=FLOOR), ["symbol", "t"]).join(pool, "symbol")
    ok = F.col("score").between(0, 5) & (F.col("volume_ratio") < 1.8) & F.col("holds")
    candidates = staged(d.select("strategy", "t", "symbol", "score", (ok & (F.col("r2") > FIT)).alias("strong"), (ok & F.col("above")).alias("weak")).where("strong or weak"))
    index = p.where("close is not null").groupBy(F.col("l1").alias("name"), "trade_date", "t").agg(F.try_divide(F.sum(F.col("close") * F.col("vol")), F.sum("vol")).alias("px"))
    prices = p.select(F.col("l1").cast("string").alias("strategy"), "t", "symbol", "open", "close")
    out = staged(holding.packed(candidates, prices, ops.votes(index), pool.groupBy("strategy").agg(F.min("symbol").alias("defensive")), F.col("t") % 2 == 0))
    discard(p), discard(candidates)
    return out


def shown(history: DataFrame) -> DataFrame:
    return history.select("strategy", "t", "reason", F.get("target", F.lit(0)).alias("target"), F.get("held", F.lit(0)).alias("held"), "since", F.expr(R("entry")).alias("entry"), "defence", "weak")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(holding.walk(sessions(spark, sf_dir), RULES))


def continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first writes its history, the second reads newer sessions only and goes on from it."""
    s = sessions(spark, sf_dir)
    history = staged(holding.walk(s.where(F.col("t") <= SAVED), WHOLE))
    return shown(history.unionByName(holding.walk(s, WHOLE, history)))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holding.replay(holding.walk(sessions(spark, sf_dir), RULES))


_R = RULES


def _rows(place: str) -> str:
    return f"""ix AS (SELECT l1, t, sum(close * vol) / nullif(sum(vol), 0) AS px FROM panel WHERE close IS NOT NULL AND l1 IS NOT NULL GROUP BY l1, t),
  im AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(px) OVER w END AS m FROM ix WHERE px IS NOT NULL WINDOW w AS (PARTITION BY l1 ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
  vt AS (SELECT t, count(*) FILTER (px < m) AS below, count(*) FILTER (px > m) AS above, CASE WHEN count(m) < 2 THEN {_R.need} ELSE least({_R.need}, count(m)) END AS enough FROM im GROUP BY t),
  cd AS (SELECT p.l1, f.t, f.symbol, annual * r2 AS score, r2 > {FIT} AS strong, above AS weak FROM fit f JOIN ps ON ps.symbol = f.symbol AND ps.t = f.t JOIN panel p ON p.symbol = f.symbol AND p.t = f.t WHERE annual * r2 BETWEEN 0 AND 5 AND vr < 1.8 AND holds),
  rk AS (SELECT l1, t, w.market, symbol, score, row_number() OVER v AS k, count(*) OVER (PARTITION BY l1, t, w.market) AS many FROM cd JOIN (VALUES (FALSE), (TRUE)) w(market) ON CASE WHEN w.market THEN weak ELSE strong END WINDOW v AS (PARTITION BY l1, t, w.market ORDER BY score DESC, symbol)),
  df AS (SELECT l1, min(symbol) AS safe FROM panel WHERE l1 IS NOT NULL GROUP BY l1),
  ds AS (SELECT DISTINCT l1, t FROM panel WHERE l1 IS NOT NULL),
  s0 AS (SELECT df.l1, -1 AS t, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS held, CAST(NULL AS INTEGER) AS since, CAST(NULL AS DOUBLE) AS entry, CAST(NULL AS INTEGER) AS defence, CAST(NULL AS INTEGER) AS weak FROM df),
  wk AS (
    SELECT * FROM s0 UNION ALL
    SELECT l1, t, reason, CASE reason WHEN 'stop' THEN safe_now WHEN 'between' THEN was WHEN 'young' THEN held WHEN 'few' THEN safe_now ELSE pick END, held, since, entry, defence, weak FROM (
      SELECT *, CASE WHEN defence IS NOT NULL THEN 'stop' WHEN t % 2 <> 0 THEN 'between' WHEN held IS NOT NULL AND t - since + 1 < {_R.least_hold} THEN 'young'
          WHEN many IS NULL OR (many < {_R.candidates} AND best < {_R.weak_score}) THEN 'few' ELSE 'best' END AS reason,
        CASE WHEN held_score >= best * CASE WHEN weak IS NULL THEN {_R.keep} ELSE 1 END THEN held ELSE first END AS pick FROM (
        SELECT c.*, a.many, a.score AS best, a.symbol AS first, h.score AS held_score FROM (
          SELECT b.*, CASE WHEN defence IS NOT NULL THEN weak0 WHEN weak0 IS NOT NULL AND (t - weak0 + 1 >= {_R.longest} OR above >= enough) THEN NULL WHEN below >= enough THEN t ELSE weak0 END AS weak FROM (
            SELECT x.*, CASE WHEN stopped THEN t WHEN t - def0 + 1 > {_R.defence} THEN NULL ELSE def0 END AS defence FROM (
              SELECT y.*, entry > 0 AND close > 0 AND close < entry * {_R.stop} AS stopped FROM (
                SELECT w.l1, w.t + 1 AS t, w.target AS was, w.target AS held, p.close, w.defence AS def0, w.weak AS weak0, vt.below, vt.above, vt.enough, CASE WHEN q.close IS NOT NULL THEN df.safe END AS safe_now,
                  CASE WHEN w.target IS NOT DISTINCT FROM w.held THEN w.since WHEN w.target IS NOT NULL THEN w.t + 1 END AS since,
                  CASE WHEN w.target IS NOT DISTINCT FROM w.held THEN w.entry WHEN p.open > 0 THEN p.open ELSE p.close END AS entry
                FROM wk w JOIN ds ON ds.l1 = w.l1 AND ds.t = w.t + 1 JOIN df ON df.l1 = w.l1 LEFT JOIN vt ON vt.t = w.t + 1 LEFT JOIN panel p ON p.symbol = w.target AND p.t = w.t + 1 LEFT JOIN panel q ON q.symbol = df.safe AND q.t = w.t + 1) y) x) b) c
          LEFT JOIN rk a ON a.l1 = c.l1 AND a.t = c.t AND a.market = (c.weak IS NOT NULL) AND a.k = 1
          LEFT JOIN rk h ON h.l1 = c.l1 AND h.t = c.t AND h.market = (c.weak IS NOT NULL) AND h.symbol = c.held{place}) d) e)"""


def _head(place: str) -> str:
    return f"WITH RECURSIVE {PANEL_SQL.strip()}, {_POINTS}, {_PASS}, {_rows(place)}"


_HEAD = _head(f" AND h.k <= {_R.depth}")
_ALL = f"SELECT CAST(l1 AS VARCHAR) AS strategy, t, reason, target, held, since, {R('entry')} AS entry, defence, weak FROM wk WHERE t >= 0"
QUERIES = {"rotation_holding_rules": rules, "rotation_continued": continued, "rotation_replay_latest": latest}
ORACLES = {
    "rotation_holding_rules": f"{_HEAD} {_ALL}",
    "rotation_continued": f"{_head('')} {_ALL}",
    "rotation_replay_latest": f"""{_HEAD}, la AS (SELECT CAST(l1 AS VARCHAR) AS strategy, t, target, held FROM wk QUALIFY t = max(t) OVER (PARTITION BY l1)),
      sy AS (SELECT strategy, t, target AS symbol FROM la WHERE target IS NOT NULL UNION SELECT strategy, t, held FROM la WHERE held IS NOT NULL)
      SELECT strategy, sy.t, symbol, CASE WHEN target = symbol THEN 1e0 ELSE 0e0 END AS weight, CASE WHEN held = symbol THEN 1e0 ELSE 0e0 END AS current FROM sy JOIN la USING (strategy)""",
}
