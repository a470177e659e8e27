"""More panel operators as declarative queries: filling, statement styles, regressions, crowding, result summaries.

``PANEL`` texts stand on the relations of ``market`` (``panel``, ``st``), ``EVAL`` texts on those of ``evaluation``
(``ev`` and what is derived from it).  Both run in Spark SQL and, as oracle, in DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelforge.plans import market
from panelforge.plans.evaluation import BASE, QR, Q, R, W, expanding, frame, frame_sql, pearson, spearman
from panelforge.plans.market import ASOF, GROUPS, INDEX, S, prior_z
from panelforge.sources import universes
from panelforge.sources.panel import PANEL_SQL, dense
from panelforge.sources.stage import staged


def combine(parts: dict[str, float]) -> str:
    """Weighted mean over the descriptors that have a value, weights renormalised."""
    total = " + ".join(f"coalesce({w}e0 * {c}, 0e0)" for c, w in parts.items())
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}e0 ELSE 0e0 END" for c, w in parts.items())
    return f"({total}) / nullif({weight}, 0e0)"


def zscore(c: str, window: str = "d") -> str:
    return f"CASE WHEN stddev_samp({c}) OVER {window} > 1e-12 THEN ({c} - avg({c}) OVER {window}) / nullif(stddev_samp({c}) OVER {window}, 0e0) END"


def ew_variance(c: str, rows: int, half: float) -> str:
    """Exponentially weighted variance over the last ``rows`` sessions, null unless all have a value."""
    raw = [0.5 ** (k / half) for k in range(rows)]
    lags = [(w / sum(raw), f"lag({c}, {k}) OVER (ORDER BY t)") for k, w in enumerate(raw)]
    mean = " + ".join(f"{w:.17e} * {x}" for w, x in lags)
    square = " + ".join(f"{w:.17e} * {x} * {x}" for w, x in lags)
    return f"greatest({square} - ({mean}) * ({mean}), 0e0 * ({mean}))"


SLOPED = "(x - avg(x) OVER d) * covar_pop(x, y) OVER d / nullif(var_pop(x) OVER d, 0e0)"
LISTED_LIFE = "life AS (SELECT symbol, min(t) AS a, max(t) AS b FROM panel WHERE close IS NOT NULL GROUP BY symbol)"
W24 = f"({S} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"

PANEL: dict[str, str] = {
    # rows of the still listed symbols only; a suspended one has no value
    "store_pack_day": f"WITH {LISTED_LIFE} SELECT p.trade_date, p.symbol, p.close FROM panel p JOIN life l ON l.symbol = p.symbol WHERE p.t BETWEEN l.a AND l.b",
    "clean_fill_suspended": "WITH have AS (SELECT symbol, trade_date, close FROM panel WHERE close IS NOT NULL) SELECT symbol, trade_date, close, 0 AS added FROM have UNION ALL SELECT p.symbol, p.trade_date, CAST(NULL AS DOUBLE), 1 FROM panel p LEFT ANTI JOIN have h ON h.symbol = p.symbol AND h.trade_date = p.trade_date",
    "clean_index_concat": f"SELECT CAST(symbol AS VARCHAR(20)) AS code, trade_date, {R('close')} AS close, {R('vol')} AS vol FROM panel WHERE close IS NOT NULL UNION ALL SELECT concat('index_', CAST(l1 AS VARCHAR(10))), trade_date, {R('sum(close * mv) / nullif(sum(mv), 0e0)')}, CAST(NULL AS DOUBLE) FROM panel WHERE close IS NOT NULL GROUP BY l1, trade_date",
    # year-to-date revenue to trailing twelve months, only from what had been announced
    "pit_ttm_ytd": f"WITH q AS (SELECT *, year(end_date - INTERVAL 1 DAY) AS y, month(end_date - INTERVAL 1 DAY) AS m FROM st), ytd AS (SELECT *, sum(revenue) OVER w AS v, count(*) OVER w AS k FROM q WINDOW w AS (PARTITION BY symbol, y ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT a.symbol, a.end_date, {R('CASE WHEN a.m = 12 THEN a.v ELSE a.v + f.v - p.v END', 2)} AS ttm FROM ytd a LEFT JOIN ytd f ON f.symbol = a.symbol AND f.y = a.y - 1 AND f.m = 12 AND f.k = 4 AND f.ann_date <= a.ann_date LEFT JOIN ytd p ON p.symbol = a.symbol AND p.y = a.y - 1 AND p.m = a.m AND p.k = a.k AND p.ann_date <= a.ann_date WHERE a.m = 3 * a.k",
    "style_statement": f"WITH {ASOF}, raw AS (SELECT a.symbol, a.d AS trade_date, CASE WHEN a.equity > 0 THEN a.equity / nullif(p.mv, 0e0) END AS btop, (a.revenue - a.cost) / nullif(p.mv, 0e0) AS cash, a.revenue / nullif(p.mv, 0e0) AS trail, (p.mv + a.debt) / nullif(p.mv, 0e0) AS mlev, a.debt / nullif(a.equity + a.debt, 0e0) AS dtoa, (a.equity + a.debt) / nullif(a.equity, 0e0) AS blev FROM pit a JOIN panel p ON p.symbol = a.symbol AND p.trade_date = a.d WHERE a.is_day = 1), "
    f"z AS (SELECT symbol, trade_date, btop, {zscore('cash')} AS cash, {zscore('trail')} AS trail, {zscore('mlev')} AS mlev, {zscore('dtoa')} AS dtoa, {zscore('blev')} AS blev FROM raw WINDOW d AS (PARTITION BY trade_date)) SELECT symbol, trade_date, {R('btop')} AS style_btop, {R(combine({'cash': 0.21, 'trail': 0.11}))} AS style_ey, {R(combine({'mlev': 0.38, 'dtoa': 0.35, 'blev': 0.27}))} AS style_leverage FROM z",
    "ts_zero_after_listing": f"SELECT symbol, trade_date, {R('CASE WHEN count(ret) OVER w > 0 THEN CASE WHEN vol > 0 THEN coalesce(ret, 0e0) ELSE 0e0 END END')} AS ret FROM panel WINDOW w AS ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "ts_holding_label": f"SELECT symbol, trade_date, {R('CASE WHEN count(e) OVER w >= 4 THEN sum(e) OVER w END')} AS label FROM (SELECT symbol, t, trade_date, ret - avg(ret) OVER (PARTITION BY t) AS e FROM panel) x WINDOW w AS ({S} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)",
    "ts_residual_std": f"WITH mk AS (SELECT t, sum(ret * mv) / nullif(sum(mv), 0e0) AS m FROM panel WHERE ret IS NOT NULL AND mv IS NOT NULL GROUP BY t), yx AS (SELECT p.symbol, p.t, p.trade_date, CASE WHEN k.m IS NOT NULL THEN p.ret END AS y, CASE WHEN p.ret IS NOT NULL THEN k.m END AS x FROM panel p LEFT JOIN mk k ON k.t = p.t) SELECT symbol, trade_date, {R('CASE WHEN count(y) OVER w >= 12 AND var_pop(x) OVER w > 1e-12 THEN sqrt(greatest(var_pop(y) OVER w - covar_pop(y, x) OVER w * covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0e0), 0e0)) END', 5)} AS hsigma FROM yx WINDOW w AS {W24}",
    "reg_specific_returns": f"SELECT symbol, trade_date, {R(f'y - avg(y) OVER d - {SLOPED}')} AS specific FROM (SELECT symbol, trade_date, t, ret AS y, ln(mv) AS x FROM panel WHERE ret IS NOT NULL AND mv IS NOT NULL) v WINDOW d AS (PARTITION BY t)",
    # cap-weighted residual by industry; groups under eight keep the raw value
    "reg_residual_fallback": f"WITH v AS (SELECT symbol, trade_date, l1, mv AS w, ln(amount) AS y, ln(mv) AS x FROM panel WHERE amount > 0 AND mv > 0), c AS (SELECT *, sum(w * y) OVER g / sum(w) OVER g AS my, sum(w * x) OVER g / sum(w) OVER g AS mx, count(*) OVER g AS n FROM v WINDOW g AS (PARTITION BY trade_date, l1)), s AS (SELECT *, sum(w * (x - mx) * (y - my)) OVER g AS sxy, sum(w * (x - mx) * (x - mx)) OVER g AS sxx FROM c WINDOW g AS (PARTITION BY trade_date, l1)) SELECT symbol, trade_date, {R('CASE WHEN n >= 8 AND sxx > 1e-12 THEN y - my - (x - mx) * sxy / nullif(sxx, 0e0) ELSE y END')} AS resid FROM s",
    # one row for each dummy that is one; the code most common in the whole panel is the reference and has none
    "reg_industry_dummies": "WITH n AS (SELECT l1 AS code, count(*) AS n FROM panel WHERE close IS NOT NULL AND l1 IS NOT NULL GROUP BY l1), ref AS (SELECT code FROM (SELECT code, row_number() OVER (ORDER BY n DESC, code) AS k FROM n) x WHERE k = 1) SELECT p.symbol, p.trade_date, p.l1 AS code, 1 AS dummy FROM (SELECT * FROM panel WHERE close IS NOT NULL AND l1 IS NOT NULL) p LEFT ANTI JOIN ref r ON r.code = p.l1",
    # latest snapshot of the index; a snapshot in percent is divided by 100
    "attr_benchmark_weights": f"WITH {INDEX}, scaled AS (SELECT snap, symbol, weight * CASE WHEN month(snap) <= 6 THEN 100 ELSE 1 END AS weight FROM idx), share AS (SELECT snap, symbol, CASE WHEN sum(weight) OVER (PARTITION BY snap) > 2 THEN weight / 100 ELSE weight END AS weight FROM scaled), snaps AS (SELECT trade_date, LASTNN[snap] OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS snap FROM (SELECT c.trade_date, i.snap FROM (SELECT DISTINCT trade_date FROM panel) c LEFT JOIN (SELECT DISTINCT snap FROM idx) i ON i.snap = c.trade_date) x) SELECT s.trade_date, i.symbol, {R('i.weight')} AS weight FROM snaps s JOIN share i ON i.snap = s.snap",
    "crowd_reverse": f"WITH {GROUPS} SELECT t, symbol, CASE WHEN g = 'H' THEN 'L' ELSE 'H' END AS side, count(*) OVER (PARTITION BY t, g) + 1 - CASE WHEN g = 'H' THEN hi ELSE lo END AS k FROM grp WHERE g IS NOT NULL",
    "crowd_relative_volatility": f"WITH {GROUPS}, b AS (SELECT t, trade_date, avg(CASE WHEN g = 'H' THEN ret END) - avg(CASE WHEN g = 'L' THEN ret END) AS hl, avg(ret) AS m FROM grp GROUP BY t, trade_date), v AS (SELECT t, trade_date, sqrt({ew_variance('hl', 12, 6)}) / nullif(sqrt({ew_variance('m', 12, 6)}), 0e0) AS v FROM b) SELECT trade_date, {R('v')} AS ratio, {R(prior_z('v'))} AS z FROM v",
    # each date and leg: mean over members of the correlation of a member's residual with the mean of the others', trailing sessions only
    "crowd_pairwise_corr": f"WITH {GROUPS}, res AS (SELECT t, symbol, y - avg(y) OVER d - {SLOPED} AS e FROM (SELECT t, symbol, ret AS y, st AS x FROM styled) v WINDOW d AS (PARTITION BY t)), past AS (SELECT m.t, m.g, m.symbol, r.t AS s, r.e FROM grp m JOIN res r ON r.symbol = m.symbol AND r.t BETWEEN m.t - 11 AND m.t WHERE m.g IS NOT NULL AND r.e IS NOT NULL), both_ AS (SELECT t, g, symbol, s, e, ((sum(e) OVER w) - e) / nullif((count(*) OVER w) - 1e0, 0e0) AS o FROM past WINDOW w AS (PARTITION BY t, g, s)) SELECT t, g AS leg, {R('avg(c)')} AS corr, count(c) AS n FROM (SELECT t, g, symbol, {pearson('e', 'o', 8)} AS c FROM both_ GROUP BY t, g, symbol) x GROUP BY t, g HAVING count(c) > 0",
}

DIRECTION = "(SELECT factor, avg(rank_ic) AS d FROM ics GROUP BY factor)"
LONG, SHORT = f"(d >= 0 AND q = {Q}) OR (d < 0 AND q = 1)", f"(d >= 0 AND q = 1) OR (d < 0 AND q = {Q})"
FAMILY = "substring(a.factor, 1, position('_' IN a.factor) - 1)"

EVAL: dict[str, str] = {
    "metric_icir_hold": f"SELECT trade_date, factor, {R(expanding('ic'))} AS ic_ir FROM (SELECT trade_date, t, factor, {pearson('f', 'r3')} AS ic FROM rk GROUP BY trade_date, t, factor) x",
    "metric_long_short_barra_corr": f"SELECT x.trade_date, x.factor, {R(f'max(CASE WHEN {LONG} THEN c END)')} AS long_corr, {R(f'max(CASE WHEN {SHORT} THEN c END)')} AS short_corr FROM (SELECT trade_date, factor, q, {pearson('x_', 'y_', 5)} AS c FROM {spearman('f', 's_size', 'qt', 'trade_date, factor, q')} y WHERE q IN (1, {Q}) GROUP BY trade_date, factor, q) x JOIN {DIRECTION} g ON g.factor = x.factor GROUP BY x.trade_date, x.factor",
    "sink_metric_summary": f"SELECT factor, metric, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS std, {R('avg(v) / nullif(stddev_samp(v), 0e0)')} AS ir, {R('avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END)')} AS positive, count(*) AS n FROM (SELECT factor, 'ic' AS metric, ic AS v FROM ics UNION ALL SELECT factor, 'rank_ic', rank_ic FROM ics) x WHERE v IS NOT NULL GROUP BY factor, metric",
    "strategy_ic_scale": f"SELECT a.factor, {R('m')} AS ic, {R('s')} AS scale FROM (SELECT factor, median(rank_ic) AS m FROM ics WHERE rank_ic IS NOT NULL GROUP BY factor) a JOIN (SELECT factor, median(s) AS s FROM (SELECT trade_date, factor, stddev_samp(r) AS s FROM ev GROUP BY trade_date, factor) x WHERE s IS NOT NULL GROUP BY factor) b ON b.factor = a.factor",
    "query_family_evaluation": f"SELECT {FAMILY} AS family, {R('avg(a.m)')} AS mean_ic, {R('avg(b.leg)')} AS leg FROM (SELECT x.factor, avg(x.rank_ic) AS m FROM ics x JOIN (SELECT max(t) AS last_t FROM ics WHERE rank_ic IS NOT NULL) z ON x.t > z.last_t - 24 GROUP BY x.factor) a JOIN (SELECT factor, q, avg(m) AS leg FROM qr GROUP BY factor, q) b ON b.factor = a.factor AND b.q = CASE WHEN a.m >= 0 THEN {Q} ELSE 1 END GROUP BY {FAMILY}",
}


def panel_query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = market.forms(text, "spark")
    got = market.relations(spark, sf_dir, text)
    return spark.sql(market._with([f"{n} AS (SELECT * FROM {{{n}}})" for n in got], text), **got)


def panel_oracle(text: str) -> str:
    return market._with([PANEL_SQL.strip(), f"st AS ({market.ST['duck']})"], market.forms(text, "duck"))


def eval_query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(f"WITH ev AS (SELECT * FROM {{ev}}), {BASE}, {QR} {text}", ev=frame(spark, sf_dir))


# codes of the symbols by rule, since the supplied tables have none
PREFIX = ("SH60", "SZ00", "SZ300", "SH688", "BJ83", "SH90")


def universe_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every universe the derived codes and constituents (the 40 largest each sixth session) give."""
    head = F.element_at(F.array(*map(F.lit, PREFIX)), F.pmod("symbol", F.lit(len(PREFIX))).cast("int") + 1)
    p = dense(spark, sf_dir).where("close is not null").select(F.concat(head, F.lpad(F.col("symbol").cast("string"), 6, "0")).alias("code"), "trade_date", "t", "mv", "symbol")
    p = staged(p)  # read once by every universe; the panel is not built again for each
    held = p.where("t % 6 = 0 and mv is not null").withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("mv"), "symbol"))).where("k <= 40")
    held = held.select(F.lit(universes.INDEX["hs300"]).alias("index_code"), "code", "trade_date")
    held = staged(held)
    return reduce(DataFrame.union, (universes.members(p, n, held).select(F.lit(n).alias("universe"), "code", "trade_date") for n in ("all", "hs300", *universes.BOARDS)))


_CODED = "coded AS (SELECT symbol, t, trade_date, mv, concat(CASE CAST(symbol % 6 AS INT) WHEN 0 THEN 'SH60' WHEN 1 THEN 'SZ00' WHEN 2 THEN 'SZ300' WHEN 3 THEN 'SH688' WHEN 4 THEN 'BJ83' ELSE 'SH90' END, lpad(CAST(symbol AS VARCHAR), 6, '0')) AS code FROM panel WHERE close IS NOT NULL)"
_HELD = "held AS (SELECT t, code FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mv DESC, symbol) AS k FROM coded WHERE t % 6 = 0 AND mv IS NOT NULL) x WHERE k <= 40)"
UNIVERSE_SQL = (
    f"WITH {PANEL_SQL.strip()}, {_CODED}, {_HELD} SELECT 'all' AS universe, code, trade_date FROM coded UNION ALL SELECT 'hs300', c.code, c.trade_date FROM coded c JOIN held h ON h.code = c.code AND h.t = c.t - c.t % 6 "
    "UNION ALL SELECT CASE CAST(symbol % 6 AS INT) WHEN 2 THEN 'gem' WHEN 3 THEN 'star' WHEN 4 THEN 'bse' ELSE 'main' END, code, trade_date FROM coded WHERE symbol % 6 <> 5"
)

QUERIES = {k: (lambda spark, sf_dir, v=v: panel_query(spark, sf_dir, v)) for k, v in PANEL.items()}
QUERIES |= {k: (lambda spark, sf_dir, v=v: eval_query(spark, sf_dir, v)) for k, v in EVAL.items()}
ORACLES = {k: panel_oracle(v) for k, v in PANEL.items()} | {k: f"WITH {frame_sql()}, {BASE}, {QR} {v}" for k, v in EVAL.items()}
QUERIES["universe_registry"], ORACLES["universe_registry"] = universe_registry, UNIVERSE_SQL
