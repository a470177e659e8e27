"""The evaluation frame and the metric catalogue.

``ev`` has one row a (date, symbol, factor): factor value ``f``, label ``r`` (return from the next open to the one
after it, clipped), ``r3`` (three sessions), the leads of the label, styles and industry.  A metric is one declarative query
over ``ev``: a grouped aggregate per (trade_date, factor), or a window over the dates of a factor.  The text runs in
Spark SQL on a DataFrame bound by name, and as DuckDB oracle on the same frame built there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans.expression import Plan
from panelforge.sources.panel import PANEL_SQL, dense

FACTORS = {"mom_5": "C/lag(C,5)-1", "reversal_1": "-R", "volume_6": "ma(V,6)/V", "price_pos": "(C-L)/iff(H-L>0,H-L,null)"}
LABELS = {
    "r": "max2(min2(lead(O,2)/lead(O,1)-1,10),-0.999)+lead(O,2)*0",
    "r3": "max2(min2(lead(O,4)/lead(O,1)-1,10),-0.999)+lead(O,4)*0",
    "s_size": "log(cap)",
    "s_mom": "C/lag(C,3)-1",
    "s_vol": "psd(R,6)",
    "r_next": "max2(min2(lead(O,3)/lead(O,2)-1,10),-0.999)+lead(O,3)*0",
}
_PLAN = Plan(FACTORS | LABELS)
_KEEP = "symbol, trade_date, t, l1, l2, mv, close, open, ret"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ev`` from the canonical panel."""
    wide = _PLAN.columns(dense(spark, sf_dir))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.col(k).alias("f")) for k in FACTORS))).alias("p")
    return wide.select("symbol", "trade_date", "t", "l1", "l2", "mv", "close", *LABELS, pairs).select("symbol", "trade_date", "t", "l1", "l2", "mv", "close", *LABELS, "p.factor", "p.f")


def frame_sql() -> str:
    ctes = _PLAN.sql()
    ctes[-1] = ctes[-1].replace("SELECT symbol, trade_date, t, close, ", "SELECT symbol, trade_date, t, close, l1, l2, mv, ")
    union = " UNION ALL ".join(f"SELECT symbol, trade_date, t, l1, l2, mv, close, {', '.join(LABELS)}, '{k}' AS factor, {k} AS f FROM factors" for k in FACTORS)
    return f"{PANEL_SQL}, {', '.join(ctes)}, ev AS ({union})"


def R(x: str, digits: int = 6) -> str:  # noqa: N802
    """Rounded alike in both engines, no negative zero."""
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits} + 0e0"


def pearson(x: str, y: str, least: int = 10) -> str:
    """Pearson over the pairs where both are present; null under ``least`` pairs or without variance."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    den = f"(stddev_samp({a}) * stddev_samp({b}))"
    return f"CASE WHEN count({a}) >= {least} AND {den} > 1e-15 THEN covar_samp({a}, {b}) / nullif({den}, 0e0) END"


# ranks: ordinal of the factor (ties by symbol), average of the label over all its valid rows, quantile bins
RK = """rk AS (
  SELECT *, CASE WHEN f IS NOT NULL THEN row_number() OVER (PARTITION BY trade_date, factor ORDER BY f NULLS LAST, symbol) END AS fo,
    count(f) OVER (PARTITION BY trade_date, factor) AS fn,
    CASE WHEN r IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, factor ORDER BY r NULLS LAST) + count(r) OVER (PARTITION BY trade_date, factor ORDER BY r NULLS LAST RANGE UNBOUNDED PRECEDING)) / 2e0 END AS ra,
    CASE WHEN r IS NOT NULL THEN row_number() OVER (PARTITION BY trade_date, factor ORDER BY r NULLS LAST, symbol) END AS ro,
    count(r) OVER (PARTITION BY trade_date, factor) AS rn
  FROM ev)"""
Q = 5
QT = f"""qt AS (
  SELECT *, CASE WHEN fn >= {Q} AND fo IS NOT NULL THEN CAST(greatest(least(ceil(fo * {Q}e0 / fn), {Q}), 1) AS INT) END AS q,
    CASE WHEN rn >= {Q} AND ro IS NOT NULL THEN CAST(greatest(least(ceil(ro * {Q}e0 / rn), {Q}), 1) AS INT) END AS rq FROM rk)"""
IC = f"ics AS (SELECT trade_date, t, factor, {pearson('f', 'r')} AS ic, {pearson('fo', 'ra')} AS rank_ic FROM rk GROUP BY trade_date, t, factor)"
BASE = f"{RK}, {QT}, {IC}"
G = "GROUP BY trade_date, factor"
QR = f"qr AS (SELECT trade_date, t, factor, q, avg(r) AS m, count(r) AS n FROM qt WHERE q IS NOT NULL GROUP BY trade_date, t, factor, q)"
O = "OVER (PARTITION BY factor ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def W(a: int, b: int = 0) -> str:  # noqa: N802
    end = "CURRENT ROW" if b == 0 else f"{b} PRECEDING"
    return f"OVER (PARTITION BY factor ORDER BY t ROWS BETWEEN {a} PRECEDING AND {end})"


def spearman(x: str, y: str, src: str, keys: str = "trade_date, factor") -> str:
    """Relation of pairwise-valid average ranks (x_, y_) of two columns."""
    avg = lambda c: f"(rank() OVER (PARTITION BY {keys} ORDER BY {c}) + count(*) OVER (PARTITION BY {keys} ORDER BY {c} RANGE UNBOUNDED PRECEDING)) / 2e0"
    return f"(SELECT {keys}, {avg(x)} AS x_, {avg(y)} AS y_ FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


def expanding(c: str) -> str:
    return f"CASE WHEN count({c}) {O} > 1 AND var_samp({c}) {O} > 1e-30 THEN avg({c}) {O} / nullif(stddev_samp({c}) {O}, 0e0) END"


# Cost rates of buying and selling (commission and stamp duty).
BUY, SELL = 0.00031, 0.00081

# Share of a quantile's symbols that were not in it the session before: one window, no self join.
TURNOVER = (
    "SELECT t, trade_date, factor, q, 1 - count(CASE WHEN t_ = t - 1 AND q_ = q THEN 1 END) / CAST(count(*) AS DOUBLE) AS turnover "
    "FROM (SELECT *, lag(q) OVER w AS q_, lag(t) OVER w AS t_ FROM qt WINDOW w AS (PARTITION BY symbol, factor ORDER BY t)) x "
    "WHERE q IS NOT NULL GROUP BY t, trade_date, factor, q"
)


def shifted(c: str, way: str, lags: tuple[int, ...]) -> str:
    """Rows of ``rk`` once for each lag, with the value (y_) and session (t_) so many sessions on: the panel is dense, so one window has all lags."""
    moved = ", ".join(f"{way}({x}, {n}) OVER w AS {x}_{n}" for n in lags for x in (c, "t"))
    pick = ", ".join(f"CASE lag_n {' '.join(f'WHEN {n} THEN {x}_{n}' for n in lags)} END AS {y}_" for x, y in ((c, "y"), ("t", "t")))
    values = ", ".join(f"({n})" for n in lags)
    return f"SELECT trade_date, factor, t, fo, lag_n, {pick} FROM (SELECT *, {moved} FROM rk WINDOW w AS (PARTITION BY symbol, factor ORDER BY t)) v JOIN (VALUES {values}) AS g(lag_n) ON 1 = 1"


METRICS: dict[str, str] = {
    "metric_ic": f"SELECT trade_date, factor, {R('ic')} AS ic FROM ics WHERE ic IS NOT NULL",
    "metric_rank_ic": f"SELECT trade_date, factor, {R('rank_ic')} AS rank_ic FROM ics WHERE rank_ic IS NOT NULL",
    "metric_rank_ic_summary": f"SELECT factor, {R('avg(rank_ic)')} AS mean, {R('stddev_samp(rank_ic)')} AS std, {R('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0e0)')} AS icir, {R('avg(CASE WHEN rank_ic > 0 THEN 1e0 WHEN rank_ic <= 0 THEN 0e0 END)')} AS positive, count(rank_ic) AS n FROM ics GROUP BY factor",
    "metric_ic_hold": f"SELECT trade_date, factor, {R(pearson('f', 'r3'))} AS ic_hold FROM rk {G}",
    "metric_rank_ic_hold": f"SELECT trade_date, factor, {R(pearson('fo', 'ra3'))} AS rank_ic_hold FROM (SELECT *, CASE WHEN r3 IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, factor ORDER BY r3 NULLS LAST) + count(r3) OVER (PARTITION BY trade_date, factor ORDER BY r3 NULLS LAST RANGE UNBOUNDED PRECEDING)) / 2e0 END AS ra3 FROM rk) x {G}",
    "metric_icir": f"SELECT trade_date, factor, {R(expanding('ic'))} AS ic_ir, {R(expanding('rank_ic'))} AS rank_ic_ir FROM ics",
    "metric_rolling_ic": f"SELECT trade_date, factor, {R(f'CASE WHEN t >= 11 THEN avg(rank_ic) {W(11)} END')} AS rolling_ic, {R(f'CASE WHEN count(rank_ic) {W(11)} = 12 THEN avg(rank_ic) {W(11)} END')} AS rolling_ic_full FROM ics",
    "metric_consistency": f"SELECT trade_date, factor, {R(f'avg(same) {O}')} AS consistency FROM (SELECT *, CASE WHEN short IS NOT NULL AND long IS NOT NULL THEN CASE WHEN sign(short) = sign(long) THEN 1e0 ELSE 0e0 END END AS same FROM (SELECT *, avg(rank_ic) {W(5)} AS short, avg(rank_ic) {W(23)} AS long FROM ics) x) y",
    "metric_weighted_ic": f"SELECT trade_date, factor, {R('ic * CASE WHEN n >= 10 AND m < 0 THEN -1e0 ELSE 1e0 END')} AS weighted_ic FROM (SELECT *, avg(rank_ic) {W(30, 1)} AS m, count(rank_ic) {W(30, 1)} AS n FROM ics) x",
    "metric_ic_decay": f"SELECT trade_date, factor, lag_n, {R(pearson('fo', 'y_'))} AS rank_ic FROM ({shifted('ra', 'lead', (1, 2, 3, 4, 5, 10, 20))}) x WHERE t_ = t + lag_n GROUP BY trade_date, factor, lag_n",
    "metric_mi_ic": f"SELECT trade_date, factor, {R('CASE WHEN hx > 0 AND hy > 0 THEN (hx + hy - hxy) / nullif(sqrt(hx * hy), 0e0) END')} AS mi FROM (SELECT j.trade_date, j.factor, min(hx) AS hx, min(hy) AS hy, -sum(p * ln(p)) AS hxy FROM (SELECT trade_date, factor, q, rq, count(*) / CAST(sum(count(*)) OVER (PARTITION BY trade_date, factor) AS DOUBLE) AS p FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, q, rq) j JOIN (SELECT trade_date, factor, -sum(p * ln(p)) AS hx FROM (SELECT trade_date, factor, q, count(*) / CAST(sum(count(*)) OVER (PARTITION BY trade_date, factor) AS DOUBLE) AS p FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, q) a GROUP BY trade_date, factor) x ON x.trade_date = j.trade_date AND x.factor = j.factor JOIN (SELECT trade_date, factor, -sum(p * ln(p)) AS hy FROM (SELECT trade_date, factor, rq, count(*) / CAST(sum(count(*)) OVER (PARTITION BY trade_date, factor) AS DOUBLE) AS p FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, rq) a GROUP BY trade_date, factor) y ON y.trade_date = j.trade_date AND y.factor = j.factor GROUP BY j.trade_date, j.factor) z",
    "metric_quantile": f"SELECT trade_date, factor, q, {R('CASE WHEN n >= 2 THEN m END')} AS mean_ret, n FROM qr",
    "metric_quantile_spread": f"SELECT trade_date, factor, {R('sum(CASE WHEN q = ' + str(Q) + ' THEN m WHEN q = 1 THEN -m END)')} AS spread, {R(pearson('q', 'mr', 3))} AS monotonic FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, factor ORDER BY m, q) AS mr, count(m) OVER (PARTITION BY trade_date, factor) AS bins FROM qr) x WHERE bins = {Q} {G}",
    "metric_quantile_nav": f"SELECT trade_date, factor, q, {R(f'sum(ln(1 + coalesce(m, 0e0))) OVER (PARTITION BY factor, q ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS log_nav FROM qr",
    "metric_quantile_ic": f"SELECT trade_date, factor, q, {R(pearson('f', 'r', 5))} AS ic, {R(pearson('fo', 'ra', 5))} AS rank_ic FROM qt WHERE q IS NOT NULL GROUP BY trade_date, factor, q",
    "metric_quantile_return_hit": f"SELECT trade_date, factor, q, {R('avg(CASE WHEN rq = ' + str(Q) + ' THEN 1e0 ELSE 0e0 END)')} AS top_hit, {R('avg(CASE WHEN rq = 1 THEN 1e0 ELSE 0e0 END)')} AS bottom_hit FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, q",
    "metric_quantile_turnover": f"SELECT trade_date, factor, q, {R('turnover')} AS turnover FROM ({TURNOVER}) x WHERE t > 0",
    "metric_quantile_factor_mean": f"SELECT trade_date, factor, q, {R('avg(f)')} AS mean_f FROM qt WHERE q IS NOT NULL GROUP BY trade_date, factor, q",
    "metric_quantile_after_cost": f"SELECT x.trade_date, x.factor, x.q, {R(f'm - CASE WHEN first_t = x.t THEN {BUY}e0 ELSE turnover * {BUY + SELL}e0 END')} AS net FROM (SELECT *, min(t) OVER (PARTITION BY factor, q) AS first_t FROM qr) x LEFT JOIN ({TURNOVER}) y ON y.t = x.t AND y.factor = x.factor AND y.q = x.q",
    "metric_factor_returns": f"SELECT trade_date, factor, {R('CASE WHEN count(f) >= 10 AND var_samp(f) > 1e-15 THEN covar_samp(f, r) / nullif(var_samp(f), 0e0) END')} AS factor_return FROM ev WHERE f IS NOT NULL AND r IS NOT NULL {G}",
    "metric_long_only": f"SELECT trade_date, factor, {R('avg(CASE WHEN f > 0 THEN r END)')} AS long_ret, {R('avg(CASE WHEN f < 0 THEN r END)')} AS short_ret, count(CASE WHEN f > 0 THEN 1 END) AS long_n, count(CASE WHEN f < 0 THEN 1 END) AS short_n FROM ev {G}",
    "metric_weighted_pnl": f"SELECT trade_date, factor, {R('sum(f * r)')} AS pnl, {R('sum(CASE WHEN f > 0 THEN f * r END)')} AS long_pnl, {R('sum(CASE WHEN f < 0 THEN f * r END)')} AS short_pnl FROM ev {G}",
    "metric_style_correlation": " UNION ALL ".join(f"SELECT trade_date, factor, '{s}' AS style, {R(pearson('x_', 'y_'))} AS corr FROM {spearman('f', s, 'ev')} x_{s} {G}" for s in ("s_size", "s_mom", "s_vol")),
    "metric_quality": f"SELECT trade_date, factor, count(*) AS total, count(f) AS valid, count(*) - count(f) AS missing, {R('count(f) / CAST(count(*) AS DOUBLE)')} AS coverage, count(DISTINCT f) AS uniques, {R('count(DISTINCT f) / nullif(CAST(count(f) AS DOUBLE), 0e0)')} AS unique_rate, {R('avg(CASE WHEN f IS NOT NULL THEN CASE WHEN abs(f - mu) > 3 * sd THEN 1e0 ELSE 0e0 END END)')} AS extreme, {R('percentile_cont(0.75) WITHIN GROUP (ORDER BY f) - percentile_cont(0.25) WITHIN GROUP (ORDER BY f)')} AS iqr FROM (SELECT *, avg(f) OVER (PARTITION BY trade_date, factor) AS mu, stddev_samp(f) OVER (PARTITION BY trade_date, factor) AS sd FROM ev) x {G}",
    "metric_factor_stats": f"SELECT trade_date, factor, {R('avg(f)')} AS mean, {R('stddev_samp(f)')} AS std, {R('median(f)')} AS median, {R('min(f)')} AS min, {R('max(f)')} AS max, {R('CASE WHEN count(f) > 2 AND avg(d * d) > 1e-20 THEN avg(d * d * d) / nullif(pow(avg(d * d), 1.5e0), 0e0) * sqrt(count(f) * (count(f) - 1e0)) / nullif(count(f) - 2e0, 0e0) END')} AS skew, {R('CASE WHEN avg(d * d) > 1e-20 THEN avg(d * d * d * d) / nullif(avg(d * d) * avg(d * d), 0e0) - 3 END')} AS kurt FROM (SELECT *, f - avg(f) OVER (PARTITION BY trade_date, factor) AS d FROM ev) x {G}",
    "metric_autocorr": f"SELECT trade_date, factor, lag_n, {R(pearson('fo', 'y_'))} AS autocorr FROM ({shifted('fo', 'lag', (1, 5, 10, 20))}) x WHERE t_ = t - lag_n GROUP BY trade_date, factor, lag_n",
    "metric_tail_hit_rate": f"SELECT trade_date, factor, q, {R('avg(CASE WHEN rq IN (1, ' + str(Q) + ') THEN 1e0 ELSE 0e0 END)')} AS tail_hit FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, q",
    "metric_tail_weighted_ic": f"SELECT trade_date, factor, {R('CASE WHEN n >= 10 AND vx * vy > 1e-30 THEN cxy / nullif(sqrt(vx * vy), 0e0) END')} AS tail_ic FROM (SELECT trade_date, factor, count(*) AS n, sum(w * f * r) / sum(w) - sum(w * f) / sum(w) * sum(w * r) / sum(w) AS cxy, sum(w * f * f) / sum(w) - sum(w * f) / sum(w) * sum(w * f) / sum(w) AS vx, sum(w * r * r) / sum(w) - sum(w * r) / sum(w) * sum(w * r) / sum(w) AS vy FROM (SELECT *, 2 * abs(fo / CAST(fn AS DOUBLE) - 0.5e0) + 1e-9 AS w FROM rk WHERE f IS NOT NULL AND r IS NOT NULL) x {G}) y",
    "metric_tail_subsample_ic": f"SELECT trade_date, factor, {R(pearson('fo', 'ra', 5))} AS tail_ic FROM qt WHERE rq IN (1, {Q}) {G}",
    "metric_tail_pair_accuracy": f"SELECT trade_date, factor, {R('(sum(CASE WHEN rq = ' + str(Q) + ' THEN k END) - na * (na + 1e0) / 2) / nullif(na * nb, 0e0)')} AS accuracy FROM (SELECT *, (rank() OVER (PARTITION BY trade_date, factor ORDER BY f) + count(*) OVER (PARTITION BY trade_date, factor ORDER BY f RANGE UNBOUNDED PRECEDING)) / 2e0 AS k, CAST(sum(CASE WHEN rq = {Q} THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date, factor) AS DOUBLE) AS na, CAST(sum(CASE WHEN rq = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date, factor) AS DOUBLE) AS nb FROM qt WHERE rq IN (1, {Q}) AND f IS NOT NULL) x GROUP BY trade_date, factor, na, nb",
    "metric_tail_separation": f"SELECT trade_date, factor, {R('sum(abs(a - b)) / 2')} AS separation FROM (SELECT trade_date, factor, q, sum(CASE WHEN rq = {Q} THEN 1e0 ELSE 0e0 END) / nullif(sum(sum(CASE WHEN rq = {Q} THEN 1e0 ELSE 0e0 END)) OVER (PARTITION BY trade_date, factor), 0e0) AS a, sum(CASE WHEN rq = 1 THEN 1e0 ELSE 0e0 END) / nullif(sum(sum(CASE WHEN rq = 1 THEN 1e0 ELSE 0e0 END)) OVER (PARTITION BY trade_date, factor), 0e0) AS b FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, q) x {G}",
    "metric_tail_concentration": f"SELECT trade_date, factor, {R(f'1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0e0 END) / ln({Q}e0)')} AS concentration FROM (SELECT trade_date, factor, q, sum(CASE WHEN rq = {Q} THEN 1e0 ELSE 0e0 END) / nullif(sum(sum(CASE WHEN rq = {Q} THEN 1e0 ELSE 0e0 END)) OVER (PARTITION BY trade_date, factor), 0e0) AS p FROM qt WHERE q IS NOT NULL AND rq IS NOT NULL GROUP BY trade_date, factor, q) x {G}",
    "metric_tail_eta2": f"SELECT trade_date, factor, {R('sum(n * (m - mu) * (m - mu)) / nullif(sum(ss), 0e0)')} AS eta2 FROM (SELECT trade_date, factor, q, mu, count(*) AS n, avg(r) AS m, sum((r - mu) * (r - mu)) AS ss FROM (SELECT *, avg(r) OVER (PARTITION BY trade_date, factor) AS mu FROM qt WHERE rq IN (1, {Q}) AND q IS NOT NULL) x GROUP BY trade_date, factor, q, mu) y {G}",
    "metric_size_stratified": f"SELECT trade_date, factor, layer, {R('avg(CASE WHEN b = 3 THEN r END) - avg(CASE WHEN b = 1 THEN r END)')} AS long_short FROM (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY trade_date, factor, layer ORDER BY f, symbol) * 3e0 / count(*) OVER (PARTITION BY trade_date, factor, layer)) AS INT) AS b FROM (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY trade_date, factor ORDER BY mv DESC, symbol) * 3e0 / count(*) OVER (PARTITION BY trade_date, factor)) AS INT) AS layer FROM ev WHERE f IS NOT NULL AND r IS NOT NULL AND mv IS NOT NULL) x) y GROUP BY trade_date, factor, layer",
    "metric_size_rank_cut": f"SELECT trade_date, factor, layer, {R('avg(CASE WHEN b = 2 THEN r END) - avg(CASE WHEN b = 1 THEN r END)')} AS long_short, count(*) AS n FROM (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY trade_date, factor, layer ORDER BY f, symbol) * 2e0 / count(*) OVER (PARTITION BY trade_date, factor, layer)) AS INT) AS b FROM (SELECT *, CASE WHEN k <= 10 THEN 1 WHEN k <= 25 THEN 2 WHEN k <= 60 THEN 3 ELSE 4 END AS layer FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, factor ORDER BY mv DESC, symbol) AS k FROM ev WHERE f IS NOT NULL AND r IS NOT NULL AND mv IS NOT NULL) w) x) y GROUP BY trade_date, factor, layer HAVING count(*) >= 5",
    "metric_factor_crowding": f"SELECT trade_date, factor, {R(f'avg(CASE WHEN q = 1 THEN 1 / nullif(close, 0e0) END) - avg(CASE WHEN q = {Q} THEN 1 / nullif(close, 0e0) END)', 9)} AS gap, {R(f'stddev_samp(CASE WHEN q IN (1, {Q}) THEN r END)')} AS tail_std FROM qt {G}",
    "metric_barra_exposure": f"SELECT trade_date, factor, q, {R('avg(s_size)')} AS size, {R('avg(s_mom)')} AS mom, {R('avg(s_vol)')} AS vol FROM qt WHERE q IS NOT NULL GROUP BY trade_date, factor, q",
    "metric_barra_corr": f"SELECT trade_date, factor, q, {R(pearson('x_', 'y_', 5))} AS corr_size FROM {spearman('f', 's_size', 'qt', 'trade_date, factor, q')} x WHERE q IS NOT NULL GROUP BY trade_date, factor, q",
    "metric_long_short_exposure": f"SELECT x.trade_date, x.factor, {R(f'sum(CASE WHEN (d > 0 AND q = {Q}) OR (d < 0 AND q = 1) THEN size ELSE -size END)')} AS size_gap FROM (SELECT trade_date, factor, q, avg(s_size) AS size FROM qt WHERE q IN (1, {Q}) GROUP BY trade_date, factor, q) x JOIN (SELECT factor, CASE WHEN avg(rank_ic) < 0 THEN -1 ELSE 1 END AS d FROM ics GROUP BY factor) y ON y.factor = x.factor GROUP BY x.trade_date, x.factor",
    "metric_direction": f"SELECT x.factor, CASE WHEN d < 0 THEN 'low' ELSE 'high' END AS side, best, worst FROM (SELECT factor, avg(rank_ic) AS d FROM ics GROUP BY factor) x JOIN (SELECT factor, max_by(q, m) AS best, min_by(q, m) AS worst FROM (SELECT factor, q, avg(m) AS m FROM qr GROUP BY factor, q) w GROUP BY factor) y ON y.factor = x.factor",
    "metric_factor_corr": f"SELECT a.factor AS f1, b.factor AS f2, {R('avg(c)')} AS corr, count(c) AS n FROM (SELECT 1 AS one) z JOIN (SELECT x.trade_date, x.factor, y.factor AS g, {pearson('x.fo', 'y.fo')} AS c FROM rk x JOIN rk y ON y.trade_date = x.trade_date AND y.symbol = x.symbol AND x.factor < y.factor GROUP BY x.trade_date, x.factor, y.factor) a ON 1 = 1 JOIN (SELECT DISTINCT factor FROM rk) b ON b.factor = a.g GROUP BY a.factor, b.factor",
    "metric_ic_corr": f"SELECT x.factor AS f1, y.factor AS f2, {R(pearson('x.rank_ic', 'y.rank_ic'))} AS corr FROM ics x JOIN ics y ON y.t = x.t AND x.factor < y.factor GROUP BY x.factor, y.factor",
    "metric_family_redundancy": f"SELECT substring(factor, 1, position('_' IN factor) - 1) AS family, {R('avg(abs(c))')} AS mean_abs, {R('max(abs(c))')} AS max_abs FROM (SELECT x.factor, y.factor AS g, {pearson('x.rank_ic', 'y.rank_ic')} AS c FROM ics x JOIN ics y ON y.t = x.t AND x.factor <> y.factor GROUP BY x.factor, y.factor) w GROUP BY 1",
    "xs_rank_pct": f"SELECT trade_date, factor, symbol, {R('(rank() OVER (PARTITION BY trade_date, factor ORDER BY f) + count(*) OVER (PARTITION BY trade_date, factor ORDER BY f RANGE UNBOUNDED PRECEDING)) / 2e0 / count(*) OVER (PARTITION BY trade_date, factor)')} AS pct FROM ev WHERE f IS NOT NULL",
    "xs_quantile_bin": f"SELECT trade_date, factor, symbol, CAST(least(floor((fo - 1) * 10e0 / fn), 9) AS INT) AS bin, q FROM qt WHERE f IS NOT NULL",
    "xs_winsor_z": f"SELECT trade_date, factor, symbol, {R('CASE WHEN sd2 < 1e-12 THEN 0e0 ELSE (w - m2) / nullif(sd2, 0e0) END')} AS z FROM (SELECT *, avg(w) OVER (PARTITION BY trade_date, factor) AS m2, stddev_pop(w) OVER (PARTITION BY trade_date, factor) AS sd2 FROM (SELECT *, CASE WHEN n >= 10 AND sd > 1e-12 THEN least(greatest(f, mu - 2.5e0 * sd), mu + 2.5e0 * sd) ELSE f END AS w FROM (SELECT *, avg(f) OVER (PARTITION BY trade_date, factor) AS mu, stddev_pop(f) OVER (PARTITION BY trade_date, factor) AS sd, count(f) OVER (PARTITION BY trade_date, factor) AS n FROM ev WHERE f IS NOT NULL) a) b) c",
    "xs_cap_standardise": f"SELECT trade_date, factor, symbol, {R('(f - cm) / nullif(sd, 0e0)')} AS z FROM (SELECT *, sum(f * mv) OVER (PARTITION BY trade_date, factor) / nullif(sum(CASE WHEN f IS NOT NULL THEN mv END) OVER (PARTITION BY trade_date, factor), 0e0) AS cm, stddev_pop(f) OVER (PARTITION BY trade_date, factor) AS sd FROM ev WHERE f IS NOT NULL AND mv IS NOT NULL) x",
    "xs_nlsize": f"SELECT trade_date, symbol, {R('c - (mc - sl * mx) - sl * x')} AS nlsize FROM (SELECT *, mc_, cxy / nullif(vx, 0e0) AS sl FROM (SELECT *, mc AS mc_, sum(mv * (x - mx) * (c - mc)) OVER (PARTITION BY trade_date) AS cxy, sum(mv * (x - mx) * (x - mx)) OVER (PARTITION BY trade_date) AS vx FROM (SELECT *, sum(mv * x) OVER (PARTITION BY trade_date) / sum(mv) OVER (PARTITION BY trade_date) AS mx, sum(mv * c) OVER (PARTITION BY trade_date) / sum(mv) OVER (PARTITION BY trade_date) AS mc FROM (SELECT trade_date, symbol, mv, s_size - 10 AS x, pow(s_size - 10, 3) AS c FROM ev WHERE factor = 'mom_5' AND mv IS NOT NULL) a) b) d) e",
    "xs_indneutral": f"SELECT trade_date, factor, symbol, {R('f - avg(f) OVER (PARTITION BY trade_date, factor, l1)')} AS x FROM ev WHERE f IS NOT NULL AND l1 IS NOT NULL",
    "xs_equal_weight_score": f"SELECT trade_date, symbol, {R('avg(z)')} AS score FROM (SELECT trade_date, symbol, CASE WHEN sd < 1e-12 THEN 0e0 ELSE (f - mu) / nullif(sd, 0e0) END * CASE WHEN factor = 'reversal_1' THEN -1 ELSE 1 END AS z FROM (SELECT *, avg(f) OVER (PARTITION BY trade_date, factor) AS mu, stddev_pop(f) OVER (PARTITION BY trade_date, factor) AS sd FROM ev) x) y GROUP BY trade_date, symbol",
    "xs_topk": "SELECT trade_date, factor, symbol, k FROM (SELECT trade_date, factor, symbol, row_number() OVER (PARTITION BY trade_date, factor ORDER BY f DESC, symbol) AS k FROM ev WHERE f IS NOT NULL) x WHERE k <= 5",
    "xs_group_snapshot": "SELECT trade_date, factor, symbol, CASE WHEN lo <= n / 5 THEN 'low' ELSE 'high' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, factor ORDER BY f, symbol) AS lo, row_number() OVER (PARTITION BY trade_date, factor ORDER BY f DESC, symbol DESC) AS hi, CAST(floor(count(*) OVER (PARTITION BY trade_date, factor)) AS INT) AS n FROM ev WHERE f IS NOT NULL) x WHERE n >= 8 AND (lo <= floor(n / 5) OR hi <= floor(n / 5))",
    "reg_single_factor": f"SELECT trade_date, factor, {R('CASE WHEN count(*) >= 8 AND var_samp(f) > 1e-20 THEN regr_slope(r, f) END')} AS slope, {R('CASE WHEN count(*) >= 8 AND var_samp(f) > 1e-20 THEN regr_intercept(r, f) END')} AS intercept FROM ev WHERE f IS NOT NULL AND r IS NOT NULL {G}",
    "reg_residual": f"SELECT trade_date, factor, symbol, {R('f - my - (x - mx) * cxy / nullif(vx, 0e0)')} AS resid FROM (SELECT *, avg(f) OVER (PARTITION BY trade_date, factor) AS my, avg(x) OVER (PARTITION BY trade_date, factor) AS mx, covar_samp(x, f) OVER (PARTITION BY trade_date, factor) AS cxy, var_samp(x) OVER (PARTITION BY trade_date, factor) AS vx FROM (SELECT *, s_size AS x FROM ev WHERE f IS NOT NULL AND s_size IS NOT NULL) a) b",
    "reg_industry_fill": f"SELECT trade_date, symbol, {R('coalesce(y, CASE WHEN n >= 3 AND vx > 1e-12 THEN my + (x - mx) * cxy / nullif(vx, 0e0) END)')} AS filled FROM (SELECT *, count(y) OVER w AS n, avg(y) OVER w AS my, avg(CASE WHEN y IS NOT NULL THEN x END) OVER w AS mx, covar_samp(CASE WHEN y IS NOT NULL THEN x END, y) OVER w AS cxy, var_samp(CASE WHEN y IS NOT NULL THEN x END) OVER w AS vx FROM (SELECT trade_date, symbol, l1, s_size AS x, CASE WHEN symbol % 7 = 0 THEN NULL ELSE f END AS y FROM ev WHERE factor = 'mom_5' AND s_size IS NOT NULL) a WINDOW w AS (PARTITION BY trade_date, l1)) b",
    "ts_prior_z": f"SELECT trade_date, factor, {R('CASE WHEN n >= 8 AND sd > 1e-12 THEN (rank_ic - m) / nullif(sd, 0e0) END')} AS z FROM (SELECT *, count(rank_ic) {W(24, 1)} AS n, avg(rank_ic) {W(24, 1)} AS m, stddev_samp(rank_ic) {W(24, 1)} AS sd FROM ics) x",
    "ts_causal_percentile": f"SELECT a.trade_date, a.factor, {R('CASE WHEN count(b.rank_ic) >= 10 THEN avg(CASE WHEN b.rank_ic IS NOT NULL THEN CASE WHEN b.rank_ic <= a.rank_ic THEN 1e0 ELSE 0e0 END END) END')} AS pct FROM ics a LEFT JOIN ics b ON b.factor = a.factor AND b.t < a.t WHERE a.rank_ic IS NOT NULL GROUP BY a.trade_date, a.factor",
    "ts_auto_direction": f"SELECT trade_date, factor, CASE WHEN count(rank_ic) {W(30, 1)} < 10 THEN 1 WHEN avg(rank_ic) {W(30, 1)} < 0 THEN -1 ELSE 1 END AS side FROM ics",
    "query_select_funnel": f"SELECT factor, {R('m')} AS mean_ic, {R('ir')} AS ir FROM (SELECT factor, avg(rank_ic) AS m, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0e0) AS ir, count(rank_ic) AS n FROM ics GROUP BY factor) x WHERE n >= 20 AND abs(m) < 1 ORDER BY abs(ir) DESC LIMIT 10",
    "query_families": f"SELECT family, {R('avg(m)')} AS mean_ic, max_by(factor, m) AS best FROM (SELECT factor, substring(factor, 1, position('_' IN factor) - 1) AS family, avg(rank_ic) AS m FROM ics GROUP BY factor) x GROUP BY family",
    "query_compare_runs": f"SELECT coalesce(a.factor, b.factor) AS factor, {R('b.m - a.m')} AS delta FROM (SELECT factor, avg(rank_ic) AS m FROM ics WHERE t < 40 GROUP BY factor) a FULL OUTER JOIN (SELECT factor, avg(rank_ic) AS m FROM ics WHERE t >= 40 GROUP BY factor) b ON a.factor = b.factor",
    "query_coverage": "SELECT factor, CASE WHEN n = 0 THEN 'no_values' WHEN n < 20 THEN 'too_few_dates' ELSE 'ok' END AS reason, n FROM (SELECT factor, count(rank_ic) AS n FROM ics GROUP BY factor) x",
}


def text(name: str) -> str:
    """The metric with the relations it stands on; Catalyst drops the unused."""
    return f"{BASE}, {QR} {METRICS[name]}"


def evaluate(ev: DataFrame, name: str) -> DataFrame:
    """Metric ``name`` over an evaluation frame."""
    return ev.sparkSession.sql("WITH ev AS (SELECT * FROM {ev}), " + text(name).replace("{", "{{").replace("}", "}}"), ev=ev)


QUERIES = {k: (lambda spark, sf_dir, k=k: evaluate(frame(spark, sf_dir), k)) for k in METRICS}
ORACLES = {k: f"WITH {frame_sql()}, {text(k)}" for k in METRICS}
