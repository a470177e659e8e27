"""Queries of the grouped kernels: regressions, recursions, simulation, allocation, streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelforge.operators import allocators, backtest, regression
from panelforge.plans.evaluation import R, frame, frame_sql
from panelforge.plans.expression import clean
from panelforge.sources.panel import PANEL_SQL, dense
from panelforge.streaming import incremental

STYLES = ["s_size", "s_mom", "s_vol"]


def ols_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regression.residuals(frame(spark, sf_dir), "f", ["s_size", "s_mom"], ["trade_date", "factor"], least=8)
    return out.select("trade_date", "factor", "symbol", clean(F.col("resid")).alias("resid"))


def style_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = frame(spark, sf_dir).where("factor = 'mom_5'").withColumn("w", F.sqrt("mv"))
    out = regression.coefficients(ev, "r", STYLES, ["trade_date"], "w", least=8)  # the styles are the same beside every factor, so one of them has all rows
    return out.select("trade_date", "name", clean(F.col("beta")).alias("beta"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regression.coefficients(frame(spark, sf_dir), "f", STYLES, ["trade_date", "factor"], least=8)
    return out.select("trade_date", "factor", "name", clean(F.col("beta")).alias("beta"))


def pure_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IC of the factor's residual on the styles."""
    ev = frame(spark, sf_dir)
    res = regression.residuals(ev, "f", STYLES, ["trade_date", "factor"], least=8)
    j = res.join(ev.select("trade_date", "factor", "symbol", "r"), ["trade_date", "factor", "symbol"]).where("r is not null")
    den = F.stddev_samp("resid") * F.stddev_samp("r")
    return j.groupBy("trade_date", "factor").agg(clean(F.when((F.count("*") >= 10) & (den > 1e-15), F.try_divide(F.covar_samp("resid", "r"), den))).alias("pure_ic"))


def nonlinear_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regression.nonlinear_ic(frame(spark, sf_dir))
    return out.select("trade_date", "factor", clean(F.col("dcor")).alias("dcor")).where("dcor is not null")


def ew_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(spark, sf_dir)
    market = p.groupBy("t").agg(F.try_divide(F.sum(F.col("ret") * F.col("mv")), F.sum(F.when(F.col("ret").isNotNull(), F.col("mv")))).alias("mkt"))
    out = regression.ew_moments(p.join(F.broadcast(market), "t"), "ret", "mkt", 24, 6, 8)  # one row a session
    return out.select("symbol", "t", *(clean(F.col(c)).alias(c) for c in ("alpha", "beta", "ew_std")))


def alarm_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(spark, sf_dir).groupBy("l1", "t").agg(F.stddev_samp("ret").alias("disp"))
    w = Window.partitionBy("l1").orderBy("t").rowsBetween(-12, -1)
    p = p.withColumn("seen", F.collect_list("disp").over(w))
    p = p.withColumn("p", F.when(F.size("seen") >= 8, F.size(F.filter("seen", lambda v: v <= F.col("disp"))) / F.size("seen")))
    return regression.alarms(p.select(F.col("l1").cast("string").alias("series"), "t", "p"), tail=0.7)


def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dense(spark, sf_dir)
    score = frame(spark, sf_dir).where("t % 3 = 0 and f is not null")
    k = score.withColumn("k", F.row_number().over(Window.partitionBy("factor", "t").orderBy(F.desc("f"), "symbol"))).where("k <= 10")
    return backtest.run(k.select(F.col("factor").alias("strategy"), "t", "symbol", F.lit(0.1).alias("weight")), p.select("symbol", "t", "open"), lot=1)


def simulation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.performance(simulation(spark, sf_dir), 12)


#: Allocators that share a task of a date: three tasks of like length in place of eleven, each of which got a copy of the returns.
SHARED = [["hrp", "max_sharpe"], ["efficient_return", "efficient_risk", "quadratic_utility"], ["equal", "min_vol", "min_l2", "min_semivariance", "min_cvar", "min_cdar"]]


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every allocator on each rebalance date, over the returns of all symbols with a value then (that session and the 24 before)."""
    p = dense(spark, sf_dir)
    past = F.collect_list(F.coalesce("ret", F.lit(0.0)) / 100).over(Window.partitionBy("symbol").orderBy("t").rowsBetween(-24, 0))  # the panel is dense: 25 values from t = 24 on
    rows = p.withColumn("past", past).where("t >= 24 and mv is not null and (month(trade_date) % 3 = 0 or t % 5 = 0)")
    rows = rows.select("trade_date", "symbol", "past", F.explode(F.array(*map(F.lit, range(len(SHARED))))).alias("part"))
    rows = rows.repartition(128, "trade_date", "part")  # few rows, much work: a given number, else small partitions are joined into few tasks

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names, pdf = SHARED[pdf["part"].iloc[0]], pdf.sort_values("symbol")
        returns = np.ascontiguousarray(np.vstack(pdf["past"]).T)
        return pd.concat(pd.DataFrame({"trade_date": pdf["trade_date"], "allocator": name, "symbol": pdf["symbol"], "weight": allocators.ALLOCATORS[name](returns, 0.3)}) for name in names)

    day = p.schema["trade_date"].dataType.simpleString()
    return rows.groupBy("trade_date", "part").applyInPandas(kernel, f"trade_date {day}, allocator string, symbol long, weight double")


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.run_available(spark, sf_dir)
    return out.select("user_id", "d", "n", clean(F.col("total"), 4).alias("total"), clean(F.col("top"), 4).alias("top"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.run_sessions(spark, sf_dir)
    return out.select("user_id", "start", "n", clean(F.col("total"), 4).alias("total"), clean(F.col("top"), 4).alias("top"))


QUERIES = {
    "stream_sessions": stream_sessions, "stream_deduplicated": incremental.run_deduplicated,
    "kernel_ols_residual": ols_residual, "kernel_style_returns": style_returns, "kernel_exposures": exposures, "kernel_pure_ic": pure_ic,
    "kernel_nonlinear_ic": nonlinear_ic, "kernel_ew_beta": ew_beta, "kernel_alarms": alarm_states,
    "kernel_backtest": simulation, "kernel_backtest_summary": simulation_summary, "kernel_allocators": allocation, "stream_event_bars": stream_bars,
}
_V = "v AS (SELECT trade_date, factor, symbol, f, s_size AS x, s_mom AS z FROM ev WHERE f IS NOT NULL AND s_size IS NOT NULL AND s_mom IS NOT NULL)"
_M = "m AS (SELECT trade_date, factor, count(*) AS n, avg(f) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(x, f) AS xy, covar_pop(z, f) AS zy, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz FROM v GROUP BY trade_date, factor)"
_P = "p AS (SELECT trade_date, factor, symbol, f, r FROM ev WHERE f IS NOT NULL AND r IS NOT NULL)"
_D = "d AS (SELECT a.trade_date, a.factor, a.symbol AS i, b.symbol AS j, abs(a.f - b.f) AS a, abs(a.r - b.r) AS b FROM p a JOIN p b ON a.trade_date = b.trade_date AND a.factor = b.factor)"
_C = "c AS (SELECT trade_date, factor, i, a - avg(a) OVER (PARTITION BY trade_date, factor, i) - avg(a) OVER (PARTITION BY trade_date, factor, j) + avg(a) OVER (PARTITION BY trade_date, factor) AS a, b - avg(b) OVER (PARTITION BY trade_date, factor, i) - avg(b) OVER (PARTITION BY trade_date, factor, j) + avg(b) OVER (PARTITION BY trade_date, factor) AS b FROM d)"


def _three(y: str, keys: str, weight: str = "1e0", where: str = "TRUE") -> str:
    """The line of ``y`` on three styles by successive projection (DuckDB): c1 .. c3, the constant c0 and the residual e of every row."""
    on = f"WINDOW g AS (PARTITION BY {keys})"
    dot = lambda a, b: f"sum(w * {a} * {b}) OVER g / sum(w * {b} * {b}) OVER g"
    mean = lambda a: f"sum(w * {a}) OVER g / sum(w) OVER g"
    return f"""l0 AS (SELECT {keys}, symbol, r, {y} AS y, s_size AS x, s_mom AS z, s_vol AS u, {weight} AS w FROM ev WHERE {y} IS NOT NULL AND s_size IS NOT NULL AND s_mom IS NOT NULL AND s_vol IS NOT NULL AND {weight} IS NOT NULL AND {where}),
  l1 AS (SELECT *, count(*) OVER g AS n, {mean("y")} AS my, {mean("x")} AS mx, {mean("z")} AS mz, {mean("u")} AS mu FROM l0 {on}),
  l2 AS (SELECT *, y - my AS yc, x - mx AS xc, z - mz AS zc, u - mu AS uc FROM l1 WHERE n >= 8),
  l3 AS (SELECT *, {dot("zc", "xc")} AS s, {dot("uc", "xc")} AS p FROM l2 {on}),
  l4 AS (SELECT *, zc - s * xc AS z1 FROM l3),
  l5 AS (SELECT *, {dot("uc", "z1")} AS q FROM l4 {on}),
  l6 AS (SELECT *, uc - p * xc - q * z1 AS u1 FROM l5),
  l7 AS (SELECT *, {dot("yc", "xc")} AS g1, {dot("yc", "z1")} AS g2, {dot("yc", "u1")} AS g3 FROM l6 {on}),
  l8 AS (SELECT *, yc - g1 * xc - g2 * z1 - g3 * u1 AS e, g3 AS c3, g2 - g3 * q AS c2, g1 - g2 * s - g3 * (p - q * s) AS c1 FROM l7)"""


def _betas(keys: str) -> str:
    parts = {"const": "my - c1 * mx - c2 * mz - c3 * mu", "s_size": "c1", "s_mom": "c2", "s_vol": "c3"}
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS name, {R(f'any_value({x})')} AS beta FROM l8 GROUP BY {keys}" for n, x in parts.items())


_EW = """mk AS (SELECT t, sum(ret * mv) / nullif(sum(CASE WHEN ret IS NOT NULL THEN mv END), 0) AS m FROM panel GROUP BY t),
  yx AS (SELECT symbol, p.t, ret AS y, m AS x FROM panel p JOIN mk ON mk.t = p.t),
  past AS (SELECT a.symbol, a.t, b.y, b.x, pow(0.5, (a.t - b.t) / 6e0) AS w FROM yx a JOIN yx b ON b.symbol = a.symbol AND b.t BETWEEN a.t - 23 AND a.t WHERE b.y IS NOT NULL AND b.x IS NOT NULL),
  mid AS (SELECT symbol, t, sum(w) AS sw, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM past GROUP BY symbol, t HAVING count(*) >= 8),
  mom AS (SELECT symbol, t, any_value(my) AS my, any_value(mx) AS mx, sum(w * (y - my) * (y - my) / sw) AS yy, sum(w * (y - my) * (x - mx) / sw) AS xy, sum(w * (x - mx) * (x - mx) / sw) AS xx FROM past JOIN mid USING (symbol, t) GROUP BY symbol, t)"""
_ALARM = """ds AS (SELECT l1, t, stddev_samp(ret) AS v FROM panel GROUP BY l1, t),
  pc AS (SELECT a.l1, a.t, CASE WHEN count(b.v) >= 8 AND sum(CASE WHEN b.v <= a.v THEN 1 ELSE 0 END) >= 0.7 * count(b.v) THEN 1 ELSE 0 END AS hit FROM ds a LEFT JOIN ds b ON b.l1 = a.l1 AND b.t BETWEEN a.t - 12 AND a.t - 1 GROUP BY a.l1, a.t),
  st8 AS (SELECT l1, t, sum(hit) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, t - coalesce(max(CASE WHEN hit = 1 THEN t END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS quiet FROM pc WINDOW w AS (PARTITION BY l1 ORDER BY t)),
  walk AS (SELECT l1, t, recent >= 3 AS active FROM st8 WHERE t = 0 UNION ALL SELECT s.l1, s.t, CASE WHEN w.active THEN s.quiet < 10 ELSE s.recent >= 3 END FROM walk w JOIN st8 s ON s.l1 = w.l1 AND s.t = w.t + 1)"""
ORACLES = {
    "kernel_style_returns": f"WITH {frame_sql()}, {_three('r', 'trade_date', 'sqrt(mv)', "factor = 'mom_5'")} {_betas('trade_date')}",
    "kernel_exposures": f"WITH {frame_sql()}, {_three('f', 'trade_date, factor')} {_betas('trade_date, factor')}",
    "kernel_pure_ic": f"WITH {frame_sql()}, {_three('f', 'trade_date, factor')} SELECT trade_date, factor, {R('CASE WHEN count(*) >= 10 AND stddev_samp(e) * stddev_samp(r) > 1e-15 THEN covar_samp(e, r) / (stddev_samp(e) * stddev_samp(r)) END')} AS pure_ic FROM l8 WHERE r IS NOT NULL GROUP BY trade_date, factor",
    "kernel_ew_beta": f"WITH {PANEL_SQL.strip()}, {_EW} SELECT y.symbol, y.t, {R('my - xy / xx * mx')} AS alpha, {R('xy / xx')} AS beta, {R('sqrt(yy)')} AS ew_std FROM yx y LEFT JOIN mom m ON m.symbol = y.symbol AND m.t = y.t",
    "kernel_alarms": f"WITH RECURSIVE {PANEL_SQL.strip()}, {_ALARM} SELECT CAST(l1 AS VARCHAR) AS series, t, active FROM walk",
    "kernel_ols_residual": f"WITH {frame_sql()}, {_V}, {_M} SELECT trade_date, factor, symbol, {R('f - my - (x - mx) * (xy * zz - zy * xz) / (xx * zz - xz * xz) - (z - mz) * (zy * xx - xy * xz) / (xx * zz - xz * xz)')} AS resid FROM v JOIN m USING (trade_date, factor) WHERE n >= 8",
    "kernel_nonlinear_ic": f"WITH {frame_sql()}, {_P}, {_D}, {_C} SELECT trade_date, factor, {R('sqrt(greatest(avg(a * b), 0) / sqrt(avg(a * a) * avg(b * b)))')} AS dcor FROM c GROUP BY trade_date, factor HAVING count(DISTINCT i) >= 10 AND sqrt(avg(a * a) * avg(b * b)) > 1e-15",
    "stream_sessions": f"""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value FROM events),
      m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
      SELECT user_id, min(ts) AS start, count(*) AS n, {R('sum(value)', 4)} AS total, {R('max(value)', 4)} AS top FROM s GROUP BY user_id, k
      HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM e)""",
    "stream_deduplicated": "SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id, ts FROM events) GROUP BY 1",
    "stream_event_bars": f"SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, {R('sum(value)', 4)} AS total, {R('max(value)', 4)} AS top FROM events GROUP BY 1, 2",
}
