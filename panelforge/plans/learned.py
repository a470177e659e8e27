"""Learned strategies over the panel.  SQL can't express a fitted model; tests hold the trees against NumPy.

The supplied bars are monthly: models look back 36 sessions, returns run over 3, and the forests are smaller than by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import boosting, exposure, neural, ranker
from panelforge.plans.evaluation import _PLAN, FACTORS, R, frame_sql
from panelforge.sources.panel import dense
from panelforge.sources.stage import discard, staged

SIGNS = {"mom_5": 1, "reversal_1": 1, "volume_6": -1, "price_pos": 1}
BOOST = boosting.Settings(trees=12, rate=0.1, least=20)
ROLLING = ranker.Rolling(lookback=36, horizon=3, refit=12, boost=BOOST)
EVERY = 3


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors side by side, written once; the universe is every symbol with a value that session."""
    wide = _PLAN.columns(dense(spark, sf_dir))
    return staged(wide.select("symbol", "trade_date", "t", "l1", "close", "mv", "s_size", "s_mom", "s_vol", *FACTORS, F.col("mv").isNotNull().alias("in_universe")))


def rebalances(p: DataFrame) -> list[int]:
    return list(range(0, p.agg(F.max("t")).first()[0] + 1, EVERY))


def rounded(df: DataFrame) -> DataFrame:
    return df.select("t", "symbol", F.round("score", 6).alias("score"), "model").where("score is not null")


def ranked_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return rounded(ranker.rolling_scores(p, SIGNS, rebalances(p), ROLLING))


def neutral(p: DataFrame) -> DataFrame:
    """Factors without their linear part in size and cubed size; written after each, since a regression reads its rows three times."""
    z = staged(exposure.standardise(p, {"size": "s_size"}, "size").select("symbol", "t", "close", "in_universe", *SIGNS, "size", "nlsize"))
    for f in SIGNS:
        done = staged(exposure.neutralised(z, f, ["size", "nlsize"], ["t"]))
        discard(z)
        z = done
    return z


def ranked_trees_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees alone (no equal-weight part), heavily smoothed, over factors neutral to size."""
    p = panel(spark, sf_dir)
    return rounded(ranker.rolling_scores(neutral(p), SIGNS, rebalances(p), ranker.Rolling(lookback=36, horizon=3, refit=12, boost=BOOST, blend=1.0, smooth=0.8)))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hidden layers on the three factors with the clearest realised rank correlation."""
    p = panel(spark, sf_dir)
    rolling = ranker.Rolling(lookback=36, horizon=3, refit=12, step=3, blend=0.8, smooth=0.7, least_groups=8)
    return rounded(neural.rolling_scores(p, SIGNS, rebalances(p), rolling, neural.Network(hidden=(8, 4), steps=30, select=3)))


def size_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten symbols by momentum with a mean standardised size within a tenth."""
    p = panel(spark, sf_dir)
    z = exposure.standardise(p, {"size": "s_size"}, "size").select("t", "symbol", F.round("mom_5", 9).alias("score"), "size")
    return ranker.bounded_picks(z, 10, 0.1)


LOOKBACK, HORIZON, LEAST, DAYS = 36, 3, 10, 8


def _icir(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = panel(spark, sf_dir)
    return neural.icir_scores(p, SIGNS, rebalances(p), LOOKBACK, HORIZON, LEAST, DAYS)


def icir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _icir(spark, sf_dir)[0].where("score is not null").select("t", "symbol", F.expr(R("score")).alias("score"))


def icir_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _icir(spark, sf_dir)[1].select("t", "factor", F.expr(R("weight")).alias("weight"))


_NAMES = ", ".join(f"('{f}', {sign})" for f, sign in SIGNS.items())
_ICIR = f"""WITH {frame_sql()}, fs AS (SELECT * FROM (VALUES {_NAMES}) v(factor, sign)),
  b AS (SELECT t, symbol, factor, sign * f AS f FROM ev JOIN fs USING (factor) WHERE mv IS NOT NULL),
  m AS (SELECT t, factor, avg(f) AS a, stddev_pop(f) AS d, count(f) AS n FROM b GROUP BY t, factor),
  z AS (SELECT t, symbol, factor, CASE WHEN n < 2 OR d < 1e-12 THEN 0 ELSE (f - a) / d END AS z FROM b JOIN m USING (t, factor) WHERE f IS NOT NULL),
  j AS (SELECT z.*, q.close / p.close - 1 AS y FROM z JOIN panel p ON p.symbol = z.symbol AND p.t = z.t JOIN panel q ON q.symbol = z.symbol AND q.t = z.t + {HORIZON} WHERE p.close > 0 AND q.close > 0),
  k AS (SELECT t, factor, (rank() OVER (PARTITION BY t, factor ORDER BY z) + count(*) OVER (PARTITION BY t, factor ORDER BY z RANGE UNBOUNDED PRECEDING)) / 2 AS x, (rank() OVER (PARTITION BY t, factor ORDER BY y) + count(*) OVER (PARTITION BY t, factor ORDER BY y RANGE UNBOUNDED PRECEDING)) / 2 AS v FROM j),
  i AS (SELECT t, factor, covar_pop(x, v) / nullif(stddev_pop(x) * stddev_pop(v), 0) AS ic FROM k GROUP BY t, factor HAVING count(*) >= {LEAST}),
  g AS (SELECT c.t, fs.factor, count(ic) AS n, avg(ic) AS mu, stddev_samp(ic) AS sd FROM cal c JOIN fs ON c.t % {EVERY} = 0 LEFT JOIN i ON i.factor = fs.factor AND i.t BETWEEN c.t - {HORIZON + LOOKBACK - 1} AND c.t - {HORIZON} GROUP BY c.t, fs.factor),
  r AS (SELECT t, factor, CASE WHEN n < {DAYS} OR t < {LOOKBACK + HORIZON - 1} THEN 0 WHEN sd < 1e-12 THEN CASE WHEN mu > 1e-12 THEN 1e6 ELSE 0 END ELSE greatest(mu / sd, 0) END AS raw FROM g),
  w AS (SELECT t, factor, CASE WHEN sum(raw) OVER (PARTITION BY t) > 0 THEN raw / sum(raw) OVER (PARTITION BY t) ELSE 1e0 / {len(SIGNS)} END AS weight FROM r)"""
QUERIES = {
    "strategy_ranked_trees": ranked_trees, "strategy_ranked_trees_neutral": ranked_trees_neutral, "strategy_neural": network, "strategy_size_bounded": size_bounded,
}
QUERIES |= {"strategy_icir": icir, "strategy_icir_weights": icir_weights}
ORACLES = {
    "strategy_icir": f"{_ICIR} SELECT t, symbol, {R('sum(weight * z) / nullif(sum(weight), 0)')} AS score FROM z JOIN w USING (t, factor) GROUP BY t, symbol HAVING sum(weight) > 0",
    "strategy_icir_weights": f"{_ICIR} SELECT t, factor, {R('weight')} AS weight FROM w",
}
