"""Queries of fund rotation over the panel; the DuckDB twins are written apart from the operators, row by row.

The supplied bars are monthly, so a year has 12 sessions and the thresholds of fit and loss are those of noisier prices; windows
are those of daily bars.  Indices of the weak-market vote are the regions.
"""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import rotation as ops
from panelforge.plans import market
from panelforge.plans.evaluation import R
from panelforge.sources.panel import PANEL_SQL, dense

ROWS, YEAR, SIGMA, N = 25, 12, 1.5, 5
CHOPPY, ROUGH = 0.08, 0.03
FIT, FLOOR = 0.05, 0.9
POOL, DAYS, LEAST, CUT = 40, 24, 12, 0.5


def scores(p: DataFrame) -> DataFrame:
    return ops.log_momentum(p, ROWS, YEAR)


def periods(p: DataFrame) -> DataFrame:
    index = p.where("close is not null").groupBy(F.col("l1").alias("name"), "trade_date", "t").agg(F.try_divide(F.sum(F.col("close") * F.col("vol")), F.sum("vol")).alias("px"))
    return ops.weak_periods(ops.votes(index))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.expr(R(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def log_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(dense(spark, sf_dir)), "score", "annual", "r2").drop("trade_date")


def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.adaptive_momentum(dense(spark, sf_dir), ROWS, YEAR, CHOPPY, ROUGH, SIGMA), "score").drop("trade_date")


def weak_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods(dense(spark, sf_dir)).select("trade_date", F.col("weak").cast("int").alias("weak"), "start")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(spark, sf_dir)
    return ops.targets(scores(p), ops.filters(p, floor=FLOOR), periods(p), N, r2=FIT)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ranked(scores(dense(spark, sf_dir)), N, FIT)


def mix_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.leg(market.run(spark, sf_dir, "strategy_momentum_long_short")), "perf")


def unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones among the ``POOL`` most traded symbols of each date."""
    p = dense(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("amount"), "symbol"))
    pool = p.where(f"amount is not null and t >= {DAYS}").withColumn("k", k).where(F.col("k") <= POOL).withColumnRenamed("amount", "money")
    return ops.unlike(pool, p, DAYS, LEAST, CUT)


def _fit(points: str, s: str) -> str:
    """points(symbol, t, x, w, y) -> fit{s}(symbol, t, annual, r2)."""
    return f"""a{s} AS (SELECT symbol, t, sum(w * w * x) / sum(w * w) AS xb, sum(w * w * y) / sum(w * w) AS yb, avg(y) AS my FROM {points} GROUP BY symbol, t),
  b{s} AS (SELECT symbol, t, any_value(xb) AS xb, any_value(yb) AS yb, any_value(my) AS my, sum(w * w * (x - xb) * (y - yb)) / sum(w * w * (x - xb) * (x - xb)) AS s FROM {points} JOIN a{s} USING (symbol, t) GROUP BY symbol, t),
  c{s} AS (SELECT symbol, t, any_value(s) AS s, sum(w * (y - yb - s * (x - xb)) * (y - yb - s * (x - xb))) AS lft, sum(w * (y - my) * (y - my)) AS al FROM {points} JOIN b{s} USING (symbol, t) GROUP BY symbol, t),
  fit{s} AS (SELECT symbol, t, exp({YEAR} * s) - 1 AS annual, CASE WHEN al > {ops.FLAT} THEN 1 - lft / al ELSE 0 END AS r2 FROM c{s})"""


_POINTS = f"""lg AS (SELECT symbol, trade_date, t, close, vol, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM panel WHERE close > 0),
  pts AS (SELECT a.symbol, a.t, b.y, b.i - a.i + {ROWS} AS x, 1 + (b.i - a.i + {ROWS}) / {ROWS}e0 AS w FROM lg a JOIN lg b ON b.symbol = a.symbol AND b.i BETWEEN a.i - {ROWS} AND a.i WHERE a.i > {ROWS}), {_fit("pts", "")}"""
_RADIUS = ceil(3 * SIGMA)
_KERNEL = ", ".join(f"({d}, {exp(-0.5 * (d / SIGMA) ** 2)!r})" for d in range(-_RADIUS, _RADIUS + 1))
_SMOOTH = f"""kern AS (SELECT d, k / sum(k) OVER () AS k FROM (VALUES {_KERNEL}) v(d, k)), tap AS (SELECT x, k, CASE WHEN abs(x + d) <= {ROWS} THEN abs(x + d) ELSE {2 * ROWS} - abs(x + d) END AS src FROM kern, (SELECT unnest(range({ROWS + 1})) AS x) o),
  gs AS (SELECT symbol, t, tap.x, 1 + tap.x / {ROWS}e0 AS w, sum(k * y) AS y FROM tap JOIN pts ON pts.x = tap.src GROUP BY symbol, t, tap.x), {_fit("gs", "g")},
  curve AS (SELECT symbol, t, sum(CASE x WHEN {ROWS - 1} THEN -2 * y WHEN {ROWS} THEN y WHEN {ROWS - 2} THEN y ELSE 0 END) AS c FROM gs GROUP BY symbol, t)"""
_VOTES = """ix AS (SELECT l1, trade_date, t, sum(close * vol) / nullif(sum(vol), 0) AS px FROM panel WHERE close IS NOT NULL GROUP BY l1, trade_date, t),
  im AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(px) OVER w END AS m FROM ix WHERE px IS NOT NULL WINDOW w AS (PARTITION BY l1 ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
  vt AS (SELECT trade_date, t, count(*) FILTER (px < m) AS below, count(*) FILTER (px > m) AS above, CASE WHEN count(m) < 2 THEN 3 ELSE least(3, count(m)) END AS need FROM im GROUP BY trade_date, t),
  wk AS (SELECT trade_date, t, CASE WHEN below >= need THEN t END AS start FROM vt WHERE t = (SELECT min(t) FROM vt)
    UNION ALL SELECT v.trade_date, v.t, CASE WHEN r.start IS NOT NULL AND (v.t - r.start + 1 >= 20 OR v.above >= v.need) THEN NULL WHEN v.below >= v.need THEN v.t ELSE r.start END FROM wk r JOIN vt v ON v.t = r.t + 1)"""
_PASS = f"""ps AS (SELECT symbol, trade_date, t, CASE WHEN i >= 10 THEN close > avg(close) OVER (o ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) ELSE FALSE END AS above,
    CASE WHEN count(vol) OVER p = 5 AND min(vol) OVER p > 0 THEN vol / avg(vol) OVER p END AS vr,
    i < 4 OR least(close / lag(close) OVER o, lag(close) OVER o / lag(close, 2) OVER o, lag(close, 2) OVER o / lag(close, 3) OVER o) >= {FLOOR} AS holds
    FROM lg WINDOW o AS (PARTITION BY symbol ORDER BY t), p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
_BEST = f"QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) <= {N}"
_K = "CAST(row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS INTEGER) AS k"
_CLONES = f"""pool AS (SELECT trade_date, t, symbol, row_number() OVER (PARTITION BY t ORDER BY amount DESC, symbol) AS k FROM panel WHERE amount IS NOT NULL AND t >= {DAYS} QUALIFY k <= {POOL}),
  win AS (SELECT o.t, o.symbol, p.t AS s, p.ret - avg(p.ret) OVER (PARTITION BY o.t, o.symbol) AS e FROM pool o JOIN panel p ON p.symbol = o.symbol AND p.t BETWEEN o.t - {DAYS - 1} AND o.t WHERE p.ret IS NOT NULL),
  sz AS (SELECT t, symbol, sqrt(sum(e * e)) AS z FROM win GROUP BY t, symbol),
  pr AS (SELECT a.t, a.symbol AS i, b.symbol AS j, sum(a.e * b.e) AS c FROM win a JOIN win b ON b.t = a.t AND b.s = a.s AND b.symbol <> a.symbol GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
  cl AS (SELECT pr.t, i, list(j) AS js FROM pr JOIN sz a ON a.t = pr.t AND a.symbol = i JOIN sz b ON b.t = pr.t AND b.symbol = j WHERE c >= {CUT} * a.z * b.z AND a.z * b.z > 1e-12 GROUP BY pr.t, i),
  walk AS (SELECT DISTINCT trade_date, t, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM pool
    UNION ALL SELECT w.trade_date, w.t, o.k, CASE WHEN cl.js IS NOT NULL AND list_has_any(w.kept, cl.js) THEN w.kept ELSE list_append(w.kept, o.symbol) END FROM walk w JOIN pool o ON o.t = w.t AND o.k = w.k + 1 LEFT JOIN cl ON cl.t = o.t AND cl.i = o.symbol)"""

_HEAD = f"WITH RECURSIVE {PANEL_SQL.strip()}"
QUERIES = {"kernel_log_momentum": log_momentum, "rotation_adaptive_momentum": adaptive, "rotation_weak_periods": weak_periods, "rotation_targets": targets, "rotation_ranked": ranked, "rotation_mix_leg": mix_leg, "rotation_unlike": unlike}
ORACLES = {
    "kernel_log_momentum": f"{_HEAD}, {_POINTS} SELECT l.symbol, l.t, {R('annual * r2')} AS score, {R('annual')} AS annual, {R('r2')} AS r2 FROM lg l LEFT JOIN fit f ON f.symbol = l.symbol AND f.t = l.t",
    "rotation_adaptive_momentum": f"{_HEAD}, {_POINTS}, {_SMOOTH} SELECT f.symbol, f.t, CASE WHEN f.r2 >= {CHOPPY} THEN {R('f.annual * f.r2')} WHEN f.r2 >= {ROUGH} THEN {R('g.annual * g.r2')} ELSE {R('least(5e0, g.annual * g.r2 + 8 * c)')} END AS score, CASE WHEN f.r2 >= {CHOPPY} THEN 'linear' WHEN f.r2 >= {ROUGH} THEN 'gauss' ELSE 'laplace' END AS kind FROM fit f JOIN fitg g ON g.symbol = f.symbol AND g.t = f.t JOIN curve v ON v.symbol = f.symbol AND v.t = f.t",
    "rotation_weak_periods": f"{_HEAD}, {_VOTES} SELECT trade_date, CASE WHEN start IS NULL THEN 0 ELSE 1 END AS weak, start FROM wk",
    "rotation_targets": f"{_HEAD}, {_POINTS}, {_VOTES}, {_PASS}, ok AS (SELECT p.trade_date, p.symbol, annual * r2 AS score FROM fit f JOIN ps p ON p.symbol = f.symbol AND p.t = f.t JOIN wk ON wk.t = f.t WHERE annual * r2 BETWEEN 0 AND 5 AND CASE WHEN start IS NULL THEN r2 > {FIT} ELSE above END AND vr < 1.8 AND holds) SELECT trade_date, symbol, {_K} FROM ok {_BEST}",
    "rotation_ranked": f"{_HEAD}, {_POINTS}, up AS (SELECT l.trade_date, f.symbol, f.annual * f.r2 AS score, count(*) FILTER (f.r2 > {FIT}) OVER (PARTITION BY f.t) AS wide FROM fit f JOIN lg l ON l.symbol = f.symbol AND l.t = f.t WHERE annual > 0 AND r2 > 0) SELECT trade_date, symbol, {_K} FROM up WHERE wide >= {N} {_BEST}",
    "rotation_mix_leg": f"{_HEAD}, sp AS ({market.TEXTS['strategy_momentum_long_short']}), pf AS (SELECT trade_date, CASE WHEN count(spread) OVER w = 5 THEN sum(spread) OVER w END AS perf FROM sp WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT trade_date, {R('perf')} AS perf, coalesce((SELECT CASE WHEN b.perf > 0 THEN 'momentum' ELSE 'a088' END FROM pf b WHERE b.trade_date <= pf.trade_date AND b.perf <> 0 ORDER BY b.trade_date DESC LIMIT 1), 'momentum') AS leg FROM pf",
    "rotation_unlike": f"{_HEAD}, {_CLONES} SELECT trade_date, unnest(kept) AS symbol FROM walk QUALIFY k = max(k) OVER (PARTITION BY t)",
}
