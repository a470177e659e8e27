"""Storage verbs, cleaning, point-in-time joins, universes, attribution and crowding as declarative queries.

Each text runs in Spark SQL on DataFrames bound by name (``panel``, ``st`` and the supplied tables) and as DuckDB
oracle on the same relations.  As-of joins are unions ordered by date with the last value carried on, one shuffle on
the symbol and no range join; interval joins are left to an equi join on the symbol plus a range predicate.

``st`` holds quarterly statements: (symbol, end_date, ann_date, revenue, cost, equity, debt).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import financial
from panelforge.plans.evaluation import R
from panelforge.plans.expression import Plan
from panelforge.sources.panel import PANEL_SQL, dense, read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# quarter ends, announced 30 to 89 days later
ST_SQL = """
SELECT symbol, end_date, {ann} AS ann_date, revenue, cost, equity, debt FROM (
  SELECT l_suppkey AS symbol, {quarter} AS end_date, sum(l_extendedprice * (1 - l_discount)) AS revenue,
    sum(l_extendedprice * l_discount) AS cost, sum(l_quantity) * 900e0 AS equity, sum(l_quantity) * 300e0 + sum(l_extendedprice * l_tax) AS debt
  FROM lineitem GROUP BY 1, 2) x"""
ST = {
    "spark": ST_SQL.format(ann="date_add(end_date, CAST(30 + symbol * 7 % 60 AS INT))", quarter="add_months(trunc(l_shipdate, 'quarter'), 3)"),
    "duck": ST_SQL.format(ann="CAST(end_date + INTERVAL 1 DAY * CAST(30 + symbol * 7 % 60 AS INTEGER) AS DATE)", quarter="CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE)"),
}
# forms that the two dialects write differently
FORMS = {
    "spark": {"LASTNN": "last_value({0}) IGNORE NULLS", "DAYS": "datediff({0}, {1})", "YEAR_AGO": "add_months({0}, -12)", "PRODUCT": "product({0})"},
    "duck": {"LASTNN": "last_value({0} IGNORE NULLS)", "DAYS": "date_diff('day', {1}, {0})", "YEAR_AGO": "CAST({0} - INTERVAL 12 MONTH AS DATE)", "PRODUCT": "product({0})"},
}
S = "PARTITION BY symbol ORDER BY t"
ASOF = """pit AS (
  SELECT symbol, d, is_day, LASTNN[revenue] OVER w AS revenue, LASTNN[cost] OVER w AS cost, LASTNN[equity] OVER w AS equity, LASTNN[debt] OVER w AS debt, LASTNN[end_date] OVER w AS end_date
  FROM (SELECT symbol, trade_date AS d, 1 AS is_day, CAST(NULL AS DOUBLE) AS revenue, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS DOUBLE) AS equity, CAST(NULL AS DOUBLE) AS debt, CAST(NULL AS DATE) AS end_date FROM panel
    UNION ALL SELECT symbol, ann_date, 0, revenue, cost, equity, debt, end_date FROM st) u
  WINDOW w AS (PARTITION BY symbol ORDER BY d, is_day, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
NAMES = "names AS (SELECT symbol, CASE WHEN symbol % 5 = 0 THEN 'ST ' ELSE '' END AS prefix, DATE '1994-01-01' AS start_date, DATE '1995-06-30' AS end_date FROM (SELECT DISTINCT symbol FROM panel) a UNION ALL SELECT symbol, '', DATE '1995-07-01', DATE '9999-12-31' FROM (SELECT DISTINCT symbol FROM panel) b)"
LISTED = "listed AS (SELECT symbol, min(trade_date) AS ipo, min(t) AS ipo_t, CASE WHEN symbol % 11 = 3 THEN DATE '1997-03-01' END AS delist FROM panel WHERE close IS NOT NULL GROUP BY symbol)"
INDEX = "idx AS (SELECT trade_date AS snap, symbol, mv / sum(mv) OVER (PARTITION BY trade_date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY mv DESC, symbol) AS k FROM panel WHERE t % 6 = 0 AND mv IS NOT NULL) x WHERE k <= 40)"
MEMBER = "member AS (SELECT symbol, l1 AS code, DATE '1900-01-01' AS in_date, DATE '1995-02-01' AS out_date FROM (SELECT DISTINCT symbol, l1 FROM panel) a UNION ALL SELECT symbol, l1 + 10, DATE '1995-02-01', DATE '9999-12-31' FROM (SELECT DISTINCT symbol, l1 FROM panel) b)"
CLEANED = "bad AS (SELECT symbol, trade_date, t, CASE WHEN symbol % 13 = 1 AND t % 17 = 3 THEN 0.01 ELSE open END AS open, CASE WHEN symbol % 13 = 2 AND t % 17 = 5 THEN low * 0.5 ELSE high END AS high, low, close, CASE WHEN symbol % 13 = 3 AND t % 17 = 7 THEN -1 ELSE vol END AS vol, CASE WHEN symbol % 13 = 4 AND t = 40 THEN 20e0 ELSE 1 + t / 100e0 END AS adj FROM panel WHERE close IS NOT NULL)"
TRADES = "trades AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS px, l_extendedprice * l_tax / 100 AS fee, l_orderkey, l_linenumber FROM lineitem)"
SIDES = "sides AS (SELECT t, trade_date, l1 AS grp, sum(wp) AS wp, sum(wp * ret) * 0.01e0 / nullif(sum(wp), 0e0) AS rp, sum(wb) AS wb, sum(wb * ret) * 0.01e0 / nullif(sum(wb), 0e0) AS rb FROM (SELECT *, w1 / sum(w1) OVER (PARTITION BY t) AS wp, w2 / sum(w2) OVER (PARTITION BY t) AS wb FROM (SELECT *, CASE WHEN symbol % 2 = 0 THEN vol ELSE 0e0 END AS w1, mv AS w2 FROM panel WHERE ret IS NOT NULL AND mv IS NOT NULL) a) b GROUP BY t, trade_date, l1)"
LINK = f"{SIDES}, per AS (SELECT t, sum(wp * coalesce(rp, 0e0)) AS rp, sum(wb * coalesce(rb, 0e0)) AS rb FROM sides GROUP BY t), eff AS (SELECT s.t, s.grp, (s.wp - s.wb) * (coalesce(s.rb, 0e0) - p.rb) AS allocation, s.wp * (coalesce(s.rp, coalesce(s.rb, 0e0)) - coalesce(s.rb, 0e0)) AS selection FROM sides s JOIN per p ON p.t = s.t)"
GROUPS = "styled AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY st, symbol) AS lo, row_number() OVER (PARTITION BY t ORDER BY st DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY t) AS n FROM (SELECT *, ln(mv) AS st FROM panel WHERE mv IS NOT NULL AND ret IS NOT NULL) x), grp AS (SELECT *, CASE WHEN lo <= floor(n / 5e0) THEN 'L' WHEN hi <= floor(n / 5e0) THEN 'H' END AS g FROM styled WHERE n >= 8)"
HL = f"{GROUPS}, hl AS (SELECT t, trade_date, avg(CASE WHEN g = 'H' THEN ret END) - avg(CASE WHEN g = 'L' THEN ret END) AS hl, stddev_samp(CASE WHEN g = 'H' THEN ret END) AS disp, stddev_samp(ret) AS market, median(CASE WHEN g = 'L' THEN 1 / close END) AS low_v, median(CASE WHEN g = 'H' THEN 1 / close END) AS high_v FROM grp GROUP BY t, trade_date)"


def over(a: int, b: int = 0) -> str:
    return f"OVER (ORDER BY t ROWS BETWEEN {a} PRECEDING AND {'CURRENT ROW' if not b else f'{b} PRECEDING'})"


def prior_z(x: str, w: int = 24, least: int = 8) -> str:
    return f"CASE WHEN count({x}) {over(w, 1)} >= {least} AND stddev_samp({x}) {over(w, 1)} > 1e-12 THEN ({x} - avg({x}) {over(w, 1)}) / nullif(stddev_samp({x}) {over(w, 1)}, 0e0) END"


TEXTS: dict[str, str] = {
    # storage verbs
    "store_read_market": "SELECT symbol, trade_date, close, vol FROM panel WHERE trade_date >= DATE '1995-01-01' AND trade_date < DATE '1996-01-01' AND symbol % 3 = 0 AND close IS NOT NULL",
    "store_back_adjust": f"SELECT symbol, trade_date, {R('close * fac')} AS close, {R('vol / nullif(fac, 0e0)')} AS vol FROM (SELECT *, CASE WHEN symbol % 10 = 0 THEN 1e0 WHEN symbol % 7 = 0 AND t % 11 = 0 THEN NULL ELSE 1 + t / 100e0 END AS fac FROM panel) x",
    "store_upsert_coalesce": "SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.trade_date, b.trade_date) AS trade_date, coalesce(b.close, a.close) AS close, coalesce(b.vol, a.vol) AS vol FROM (SELECT * FROM panel WHERE t < 50) a FULL OUTER JOIN (SELECT symbol, trade_date, CASE WHEN symbol % 2 = 0 THEN close * 2 END AS close, vol FROM panel WHERE t >= 45) b ON a.symbol = b.symbol AND a.trade_date = b.trade_date",
    "store_instruments": "SELECT symbol, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n FROM panel WHERE close IS NOT NULL GROUP BY symbol",
    "store_trade_dates": "SELECT DISTINCT trade_date FROM panel WHERE close IS NOT NULL AND trade_date <= DATE '1998-01-01'",
    "store_calendar_union": "SELECT trade_date FROM panel WHERE t < 40 UNION SELECT trade_date FROM panel WHERE t > 30",
    "store_missing_dates": "SELECT a.symbol, a.trade_date FROM panel a LEFT ANTI JOIN (SELECT symbol, trade_date FROM panel WHERE close IS NOT NULL) b ON a.symbol = b.symbol AND a.trade_date = b.trade_date",
    "store_delete_symbols": "SELECT symbol, count(*) AS n FROM panel p LEFT ANTI JOIN (SELECT DISTINCT symbol AS s FROM panel WHERE symbol % 4 = 1) d ON p.symbol = d.s GROUP BY symbol",
    "store_prune_sources": "SELECT c_custkey, c_mktsegment FROM customer LEFT SEMI JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer WHERE c_mktsegment < 'F') a ON c_mktsegment = m",
    "store_dedupe_key": "SELECT symbol, end_date, ann_date, " + R("revenue", 2) + " AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY symbol, end_date ORDER BY ann_date DESC, revenue DESC) AS k FROM st) x WHERE k = 1",
    "store_watermark": "SELECT l1, max(trade_date) AS last_date FROM panel WHERE close IS NOT NULL GROUP BY l1",
    "store_trim_from": "SELECT symbol, count(*) AS n FROM panel WHERE trade_date < DATE '1997-06-01' AND close IS NOT NULL GROUP BY symbol",
    "store_coverage_audit": "SELECT trade_date, count(*) AS rows_n, count(close) AS close_n, CASE WHEN count(close) >= count(*) THEN 1 ELSE 0 END AS complete FROM panel GROUP BY trade_date",
    "store_readiness": "SELECT symbol, min(CASE WHEN ret IS NOT NULL THEN trade_date END) AS first_valid, count(ret) AS n, CASE WHEN count(ret) >= 80 THEN 1 ELSE 0 END AS ready FROM panel GROUP BY symbol",
    # cleaning
    "clean_codes": "SELECT s_suppkey, concat('SZ', lpad(CAST(s_suppkey AS VARCHAR(10)), 6, '0')) AS code, replace(s_name, '#', '_') AS name FROM supplier",
    "clean_outer_merge": "SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.trade_date, b.trade_date) AS trade_date, a.close, b.vol FROM (SELECT symbol, trade_date, close FROM panel WHERE t % 2 = 0) a FULL OUTER JOIN (SELECT symbol, trade_date, vol FROM panel WHERE t % 3 = 0) b ON a.symbol = b.symbol AND a.trade_date = b.trade_date",
    "clean_sanitize": f"WITH {CLEANED} SELECT symbol, trade_date, {R('CASE WHEN low_px = 1 OR broken = 1 THEN NULL ELSE close END')} AS close, {R('CASE WHEN vol > 0 THEN vol END')} AS vol, {R('CASE WHEN adj > 0 AND NOT coalesce(adj / prev >= 8 OR adj / prev <= 0.125, false) THEN adj END')} AS adj FROM (SELECT *, CASE WHEN least(open, high, low, close) <= 0.05 THEN 1 ELSE 0 END AS low_px, CASE WHEN high < greatest(open, close) OR low > least(open, close) THEN 1 ELSE 0 END AS broken, lag(adj) OVER ({S}) AS prev FROM bad) x",
    "clean_limit_ratio": f"WITH {NAMES}, {LISTED} SELECT p.symbol, p.trade_date, CASE WHEN p.t - l.ipo_t = 0 THEN 0.44e0 WHEN p.t - l.ipo_t < 3 THEN NULL WHEN n.prefix = 'ST ' THEN 0.05e0 WHEN p.symbol % 4 = 0 THEN 0.2e0 WHEN p.symbol % 9 = 0 THEN 0.3e0 ELSE 0.1e0 END AS ratio FROM panel p JOIN listed l ON l.symbol = p.symbol LEFT JOIN names n ON n.symbol = p.symbol AND p.trade_date BETWEEN n.start_date AND n.end_date WHERE p.t >= l.ipo_t",
    "clean_fill_limits": f"SELECT symbol, trade_date, {R('coalesce(CASE WHEN symbol % 2 = 0 THEN pre * 1.2e0 END, floor(pre * 1.1e0 * 100 + 0.5e0) / 100)', 4)} AS up_limit FROM (SELECT *, lag(close) OVER ({S}) AS pre FROM panel) x WHERE pre IS NOT NULL",
    "clean_st_mask": f"WITH {NAMES} SELECT p.symbol, p.trade_date, CASE WHEN n.prefix LIKE 'ST%' THEN 1 ELSE 0 END AS is_st FROM panel p LEFT JOIN names n ON n.symbol = p.symbol AND p.trade_date BETWEEN n.start_date AND n.end_date",
    "clean_ipo_session": f"WITH {LISTED} SELECT p.symbol, p.trade_date, p.t - l.ipo_t + 1 AS session FROM panel p JOIN listed l ON l.symbol = p.symbol WHERE p.t >= l.ipo_t",
    "clean_prev_adj": f"WITH {CLEANED} SELECT symbol, max_by(adj, t) AS prev_adj FROM bad WHERE trade_date < DATE '1996-01-01' GROUP BY symbol",
    "clean_forward_adjust": f"SELECT symbol, trade_date, {R('exp(coalesce(sum(ln(step)) OVER (PARTITION BY symbol ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))')} AS factor FROM (SELECT *, CASE WHEN pre / close BETWEEN 0.05e0 AND 20 AND abs(ln(pre / close)) >= ln(1.15e0) THEN pre / close ELSE 1e0 END AS step FROM (SELECT symbol, trade_date, t, close, coalesce(lag(close) OVER ({S}), close) * CASE WHEN t % 20 = 7 THEN 0.5e0 ELSE 1e0 END / coalesce(lag(close) OVER ({S}), close) * close AS pre FROM panel WHERE close IS NOT NULL) x) y",
    "clean_percent_scale": f"SELECT symbol, trade_date, {R('CASE WHEN med > 2 THEN vol / 100 ELSE vol END')} AS scaled FROM panel CROSS JOIN (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY abs(vol)) AS med FROM panel) m WHERE vol IS NOT NULL",
    # point-in-time joins and universes
    "pit_announcement_asof": f"WITH {ASOF} SELECT symbol, d AS trade_date, {R('revenue', 2)} AS revenue, {R('equity', 2)} AS equity, end_date FROM pit WHERE is_day = 1",
    "pit_ttm": f"SELECT symbol, end_date, {R('sum(revenue) OVER (PARTITION BY symbol ORDER BY end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 2)} AS ttm FROM st",
    "pit_yoy": f"SELECT a.symbol, a.end_date, {R('a.revenue / nullif(b.revenue, 0e0) - 1')} AS yoy FROM st a JOIN st b ON b.symbol = a.symbol AND b.end_date = YEAR_AGO[a.end_date] AND b.ann_date <= a.ann_date",
    "pit_growth_slope": f"SELECT symbol, y, {R('CASE WHEN n >= 4 THEN sl / nullif(ma, 0e0) END')} AS growth FROM (SELECT symbol, y, count(v) OVER w AS n, regr_slope(v, CAST(y AS DOUBLE)) OVER w AS sl, avg(abs(v)) OVER w AS ma FROM (SELECT symbol, year(end_date) AS y, sum(revenue) AS v FROM st GROUP BY 1, 2) a WINDOW w AS (PARTITION BY symbol ORDER BY y ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) x",
    "pit_annual_geomean": f"SELECT symbol, y, {R('CASE WHEN n >= 4 THEN exp(m) - 1 END')} AS roe_geo FROM (SELECT symbol, y, count(*) OVER w AS n, avg(ln(1 + roe)) OVER w AS m FROM (SELECT symbol, year(end_date) AS y, sum(revenue - cost) / sum(equity) AS roe FROM st GROUP BY 1, 2) a WINDOW w AS (PARTITION BY symbol ORDER BY y ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) x",
    "pit_financial_factors": f"WITH {ASOF} SELECT a.symbol, a.d AS trade_date, {R('(revenue - cost) / nullif(equity, 0e0)')} AS roe, {R('debt / nullif(equity + debt, 0e0)')} AS debt_to_assets, {R('revenue / nullif(mv, 0e0)')} AS sales_to_price, {R('equity / nullif(mv, 0e0)')} AS book_to_price, {R('cost / nullif(revenue, 0e0)')} AS cost_ratio, {R('revenue / nullif(equity + debt, 0e0)')} AS asset_turnover FROM pit a JOIN panel p ON p.symbol = a.symbol AND p.trade_date = a.d WHERE is_day = 1 AND revenue IS NOT NULL",
    "pit_industry_interval": f"WITH {MEMBER} SELECT p.symbol, p.trade_date, m.code FROM panel p JOIN member m ON m.symbol = p.symbol AND m.in_date <= p.trade_date AND p.trade_date < m.out_date",
    "pit_index_members": f"WITH {INDEX}, snaps AS (SELECT trade_date, LASTNN[snap] OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS snap FROM (SELECT c.trade_date, i.snap FROM (SELECT DISTINCT trade_date FROM panel) c LEFT JOIN (SELECT DISTINCT snap FROM idx) i ON i.snap = c.trade_date) x) SELECT s.trade_date, i.symbol, {R('i.weight')} AS weight FROM snaps s JOIN idx i ON i.snap = s.snap",
    "universe_listing_age": f"WITH {LISTED} SELECT p.symbol, p.trade_date, CASE WHEN p.t < l.ipo_t + 6 THEN 0 ELSE 1 END AS ok FROM panel p LEFT JOIN listed l ON l.symbol = p.symbol",
    "universe_delist": f"WITH {LISTED} SELECT p.symbol, p.trade_date, CASE WHEN l.delist IS NOT NULL AND (p.trade_date >= l.delist OR p.nxt >= l.delist) THEN 0 ELSE 1 END AS ok FROM (SELECT *, lead(trade_date) OVER ({S}) AS nxt FROM panel) p LEFT JOIN listed l ON l.symbol = p.symbol",
    "universe_board": "SELECT symbol, CASE WHEN code LIKE 'SZ00%' THEN 'main' WHEN code LIKE 'SZ30%' THEN 'gem' ELSE 'star' END AS board FROM (SELECT s_suppkey AS symbol, concat('SZ', CASE WHEN s_suppkey % 3 = 0 THEN '30' WHEN s_suppkey % 3 = 1 THEN '00' ELSE '68' END, lpad(CAST(s_suppkey AS VARCHAR(10)), 4, '0')) AS code FROM supplier) x",
    "universe_mask": f"WITH {NAMES}, {LISTED} SELECT p.symbol, p.trade_date FROM panel p JOIN listed l ON l.symbol = p.symbol LEFT JOIN names n ON n.symbol = p.symbol AND p.trade_date BETWEEN n.start_date AND n.end_date WHERE p.open IS NOT NULL AND p.t >= l.ipo_t + 6 AND coalesce(n.prefix, '') <> 'ST ' AND (l.delist IS NULL OR p.trade_date < l.delist)",
    "schedule_rebalance": "SELECT trade_date, t FROM (SELECT DISTINCT trade_date, t FROM panel) x WHERE month(trade_date) % 3 = 0 OR t % 5 = 0",
    # strategies as set queries
    "strategy_small_cap": "SELECT trade_date, symbol, k FROM (SELECT trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY mv, symbol) AS k FROM panel WHERE mv IS NOT NULL AND vol > 0) x WHERE k <= 10",
    "strategy_market_breadth": f"SELECT trade_date, l1, {R('avg(CASE WHEN close > m THEN 1e0 WHEN close <= m THEN 0e0 END)')} AS breadth FROM (SELECT *, avg(close) OVER ({S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM panel) x GROUP BY trade_date, l1",
    "strategy_weak_vote": f"SELECT trade_date, CASE WHEN sum(below) >= 3 THEN 1 ELSE 0 END AS weak FROM (SELECT trade_date, l1, CASE WHEN px < avg(px) OVER (PARTITION BY l1 ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS below FROM (SELECT trade_date, l1, sum(close * vol) / sum(vol) AS px FROM panel WHERE close IS NOT NULL GROUP BY trade_date, l1) a) b GROUP BY trade_date",
    "strategy_cost_gate": f"SELECT trade_date, symbol, CASE WHEN abs(ret) >= 2 * 0.00112e0 THEN 1 ELSE 0 END AS trade FROM panel WHERE ret IS NOT NULL",
    "strategy_momentum_long_short": f"SELECT b.trade_date, {R('avg(CASE WHEN b.k <= b.n * 0.2e0 THEN p.ret END) - avg(CASE WHEN b.k > b.n * 0.8e0 THEN p.ret END)')} AS spread FROM (SELECT symbol, t, trade_date, row_number() OVER (PARTITION BY t ORDER BY m DESC, symbol) AS k, count(*) OVER (PARTITION BY t) AS n FROM (SELECT symbol, t, trade_date, close / nullif(lag(close, 5) OVER ({S}), 0e0) - 1 AS m FROM panel) a WHERE m IS NOT NULL) b JOIN panel p ON p.symbol = b.symbol AND p.t = b.t + 1 GROUP BY b.trade_date",
    "strategy_sector_pool": "SELECT trade_date, grp, max_by(symbol, amount) AS best FROM (SELECT trade_date, symbol, amount, CAST(symbol % 10 AS INT) AS grp FROM panel WHERE amount IS NOT NULL) x GROUP BY trade_date, grp",
    "allocator_equal": f"SELECT trade_date, symbol, {R('1e0 / count(*) OVER (PARTITION BY trade_date)')} AS weight FROM (SELECT trade_date, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY mv DESC, symbol) AS k FROM panel WHERE mv IS NOT NULL) x WHERE k <= 20",
    "live_order_plan": f"SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.lots, 0) - coalesce(a.lots, 0) AS delta, CASE WHEN coalesce(b.lots, 0) > coalesce(a.lots, 0) THEN 'buy' WHEN coalesce(b.lots, 0) < coalesce(a.lots, 0) THEN 'sell' ELSE 'hold' END AS side FROM (SELECT symbol, CAST(floor(vol / 10) AS BIGINT) AS lots FROM panel WHERE t = 40 AND symbol % 2 = 0 AND vol IS NOT NULL) a FULL OUTER JOIN (SELECT symbol, CAST(floor(vol / 10) AS BIGINT) AS lots FROM panel WHERE t = 41 AND symbol % 3 = 0 AND vol IS NOT NULL) b ON a.symbol = b.symbol",
    # attribution
    "attr_trade_mtm": f"WITH {TRADES} SELECT x.symbol, x.l_orderkey, x.l_linenumber, {R('side * qty * (close - px) - fee', 4)} AS pnl FROM trades x JOIN panel p ON p.symbol = x.symbol AND year(p.trade_date) = year(x.d) AND month(p.trade_date) = month(x.d)",
    "attr_holding_mtm": f"SELECT symbol, trade_date, {R('vol * (close - pre) - amount * 0.0001e0', 4)} AS pnl FROM (SELECT *, lag(close) OVER ({S}) AS pre FROM panel) x WHERE pre IS NOT NULL AND close IS NOT NULL",
    "attr_positions": f"WITH {TRADES} SELECT symbol, d, {R('sum(q) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS position FROM (SELECT symbol, d, sum(side * qty) AS q FROM trades GROUP BY symbol, d) x",
    "attr_period_returns": f"SELECT trade_date, {R('v / nullif(lag(v) OVER (ORDER BY t), 0e0) - 1')} AS ret FROM (SELECT t, trade_date, 1000000 + sum(close * shares) AS v FROM (SELECT t, trade_date, close, 10 + symbol % 5 AS shares FROM panel WHERE close IS NOT NULL) a GROUP BY t, trade_date) x",
    "attr_bhb": f"WITH {SIDES} SELECT trade_date, grp, {R('CASE WHEN rp IS NULL OR rb IS NULL THEN (wp * coalesce(rp, 0e0)) - wb * coalesce(rb, 0e0) ELSE (wp - wb) * rb END', 9)} AS allocation, {R('CASE WHEN rp IS NULL OR rb IS NULL THEN 0e0 ELSE wp * (rp - rb) END', 9)} AS selection FROM sides",
    "attr_brinson_fachler": f"WITH {LINK} SELECT t, grp, {R('allocation', 9)} AS allocation, {R('selection', 9)} AS selection FROM eff",
    "attr_carino": f"WITH {LINK}, k AS (SELECT t, rp, rb, CASE WHEN abs(rp - rb) < 1e-14 THEN 1 / (1 + rp) ELSE (ln(1 + rp) - ln(1 + rb)) / nullif(rp - rb, 0e0) END AS kt FROM per), tot AS (SELECT exp(sum(ln(1 + rp))) - 1 AS p, exp(sum(ln(1 + rb))) - 1 AS b FROM k) SELECT e.grp, {R('sum(e.allocation * k.kt / kk)', 2)} AS allocation, {R('sum(e.selection * k.kt / kk)', 2)} AS selection FROM eff e JOIN k ON k.t = e.t JOIN (SELECT CASE WHEN abs(p - b) < 1e-14 THEN 1 / (1 + p) ELSE (ln(1 + p) - ln(1 + b)) / nullif(p - b, 0e0) END AS kk FROM tot) z ON 1 = 1 GROUP BY e.grp",
    "attr_wealth_link": f"WITH {LINK}, later AS (SELECT t, coalesce(sum(ln(1 + rp)) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS g FROM per) SELECT e.grp, {R('sum((e.allocation + e.selection) * exp(g))', 8)} AS effect FROM eff e JOIN later l ON l.t = e.t GROUP BY e.grp",
    # linking within each calendar year
    "attr_carino_year": f"WITH {LINK}, k AS (SELECT p.t, c.y, p.rp, p.rb, CASE WHEN abs(rp - rb) < 1e-14 THEN 1 / (1 + rp) ELSE (ln(1 + rp) - ln(1 + rb)) / nullif(rp - rb, 0e0) END AS kt FROM per p JOIN (SELECT DISTINCT t, year(trade_date) AS y FROM panel) c ON c.t = p.t), tot AS (SELECT y, exp(sum(ln(1 + rp))) - 1 AS p, exp(sum(ln(1 + rb))) - 1 AS b FROM k GROUP BY y) SELECT k.y, e.grp, {R('sum(e.allocation * k.kt / kk)', 8)} AS allocation, {R('sum(e.selection * k.kt / kk)', 8)} AS selection FROM eff e JOIN k ON k.t = e.t JOIN (SELECT y, CASE WHEN abs(p - b) < 1e-14 THEN 1 / (1 + p) ELSE (ln(1 + p) - ln(1 + b)) / nullif(p - b, 0e0) END AS kk FROM tot) z ON z.y = k.y GROUP BY k.y, e.grp",
    "attr_wealth_link_year": f"WITH {LINK}, later AS (SELECT p.t, c.y, coalesce(sum(ln(1 + p.rp)) OVER (PARTITION BY c.y ORDER BY p.t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS g FROM per p JOIN (SELECT DISTINCT t, year(trade_date) AS y FROM panel) c ON c.t = p.t) SELECT l.y, e.grp, {R('sum((e.allocation + e.selection) * exp(g))', 8)} AS effect FROM eff e JOIN later l ON l.t = e.t GROUP BY l.y, e.grp",
    "attr_onion": f"WITH {LINK} SELECT t, {R('sum(allocation)', 9)} AS allocation, {R('sum(selection)', 9)} AS selection, {R('sum(allocation + selection)', 9)} AS total FROM eff GROUP BY t",
    "attr_factor": f"SELECT a.t, {R('sum(a.x * f.f)', 8)} AS explained, {R('avg(a.ret)', 8)} AS total, {R('avg(a.ret) - avg(a.x) * avg(f.f)', 8)} AS residual FROM (SELECT symbol, t, ret, ln(lag(mv) OVER ({S})) AS x FROM panel) a JOIN (SELECT t, regr_slope(ret, lx) AS f FROM (SELECT t, ret, ln(lag(mv) OVER ({S})) AS lx FROM panel) b WHERE ret IS NOT NULL AND lx IS NOT NULL GROUP BY t) f ON f.t = a.t WHERE a.ret IS NOT NULL AND a.x IS NOT NULL GROUP BY a.t",
    "attr_bond": f"SELECT l_orderkey, l_linenumber, {R('carry + curve + spread + convexity', 8)} AS explained, {R('l_discount - carry - curve - spread - convexity', 8)} AS residual FROM (SELECT *, l_tax / 12 AS carry, -l_quantity / 10 * 0.001e0 AS curve, -l_quantity / 20 * 0.0005e0 AS spread, 0.5e0 * l_quantity * 0.000001e0 AS convexity FROM lineitem) x",
    "attr_futures": f"SELECT l_orderkey, l_linenumber, {R('l_quantity * (0.01e0 * l_tax) + l_quantity * 0.002e0 - l_quantity * 0.0005e0 + l_extendedprice * 0.0001e0', 6)} AS total FROM lineitem",
    "attr_option": f"SELECT l_orderkey, l_linenumber, {R('0.5e0 * d + 0.5e0 * 0.02e0 * d * d + 0.1e0 * l_discount - 0.01e0 + 0.03e0 * l_tax', 8)} AS explained FROM (SELECT *, l_quantity / 50 AS d FROM lineitem) x",
    # style crowding
    "crowd_hl_return": f"WITH {HL} SELECT trade_date, {R('hl', 9)} AS hl FROM hl",
    "crowd_valuation_z": f"WITH {HL} SELECT trade_date, {R(prior_z('v'))} AS z FROM (SELECT *, ln(low_v / nullif(high_v, 0e0)) AS v FROM hl) x",
    "crowd_price_stretch": f"WITH {HL} SELECT trade_date, {R(f'CASE WHEN count(hl) {over(11)} >= 10 THEN sum(ln(1 + greatest(hl, -0.999e0))) {over(11)} END')} AS log_stretch FROM hl",
    "crowd_dispersion": f"WITH {HL} SELECT trade_date, {R('disp')} AS disp, {R('disp / nullif(market, 0e0)')} AS rel FROM hl",
    "crowd_dispersion_spike": f"WITH {HL} SELECT trade_date, {R(f'0.5e0 * ({prior_z("m")}) + 0.5e0 * ({prior_z("c")})')} AS spike FROM (SELECT *, m - lag(m, 4) OVER (ORDER BY t) AS c FROM (SELECT *, CASE WHEN t >= 4 THEN avg(disp) {over(3)} END AS m FROM hl) x) y",
    "crowd_volatility": f"WITH {HL} SELECT trade_date, {R(f'stddev_samp(hl) {over(11)} * sqrt(252e0)')} AS vol, {R(f'avg(hl) {over(5)}', 9)} AS mom FROM hl",
    "crowd_temperature": f"WITH {HL} SELECT a.trade_date, {R('greatest(avg(CASE WHEN b.disp <= a.disp THEN 1e0 ELSE 0e0 END), 1 - avg(CASE WHEN b.disp <= a.disp THEN 1e0 ELSE 0e0 END))')} AS temperature FROM hl a JOIN hl b ON b.t < a.t GROUP BY a.trade_date HAVING count(*) >= 10",
    "crowd_market_exposure": f"WITH {GROUPS} SELECT trade_date, {R('sum(st * mv) / sum(mv)')} AS exposure FROM grp GROUP BY trade_date",
    "crowd_splice": f"WITH {HL} SELECT trade_date, {R('hl', 9)} AS hl, 'head' AS part FROM hl WHERE t < 60 UNION ALL SELECT trade_date, {R('hl', 9)}, 'tail' FROM hl WHERE t >= 60",
    # event bars
    "events_daily_bars": f"SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, {R('sum(value)')} AS total, {R('max(value)')} AS top FROM events GROUP BY 1, 2",
}


def forms(text: str, dialect: str) -> str:
    for name, form in FORMS[dialect].items():
        text = re.sub(rf"\b{name}\[([^\[\]]*)\]", lambda m, form=form: form.format(*(x.strip() for x in m[1].split(","))), text)
    return text if dialect == "spark" else re.sub(r"LEFT (ANTI|SEMI) JOIN", lambda m: f"{m[1]} JOIN", text)


def _with(head: list[str], text: str) -> str:
    """Puts relations in front of a text that may have a WITH of its own."""
    return f"WITH {', '.join(head)}, {text[5:]}" if text.startswith("WITH ") else f"WITH {', '.join(head)} {text}"


def _uses(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN) {name}\b", text) is not None


def relations(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """The bound relations that a text mentions."""
    got = {n: read(spark, sf_dir, n) for n in TABLES if _uses(text, n)}
    if _uses(text, "st"):
        got["st"] = spark.sql(ST["spark"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))
    if _uses(text, "panel"):
        got["panel"] = dense(spark, sf_dir)
    return got


def bound(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = forms(text, "spark")
    got = relations(spark, sf_dir, text)
    return spark.sql(_with([f"{n} AS (SELECT * FROM {{{n}}})" for n in got], text), **got)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound(spark, sf_dir, TEXTS[name])


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the sessions before whose dispersion was no larger; a window over one row a session, where the text's join makes Spark compute the groups once for each pair of partitions."""
    hl = bound(spark, sf_dir, f"WITH {HL} SELECT t, trade_date, disp FROM hl")
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    d = hl.select("trade_date", "disp", F.count("*").over(before).alias("n"), F.collect_list("disp").over(before).alias("past")).where("n >= 10")
    share = F.size(F.filter("past", lambda x: x <= F.col("disp"))) / F.col("n")
    return d.select("trade_date", share.alias("share")).select("trade_date", F.expr(R("greatest(share, 1 - share)")).alias("temperature"))


def oracle(name: str) -> str:
    return _with([PANEL_SQL.strip(), f"st AS ({ST['duck']})"], forms(TEXTS[name], "duck"))


# a stand-in for a vendor's indicator table: every indicator is a ratio of the four statement fields, fixed by its place in the list
INDICATOR_SQL = ", ".join(f"(revenue * {1 + i % 5} + cost * {i % 7}) / nullif(equity * {2 + i % 3} + debt * {1 + i % 4}, 0e0) AS {name}" for i, name in enumerate(financial.INDICATORS))
FINANCIAL = f"WITH {ASOF} SELECT p.*, {INDICATOR_SQL} FROM panel p LEFT JOIN (SELECT symbol AS s_, d, revenue, cost, equity, debt FROM pit WHERE is_day = 1) a ON a.s_ = p.symbol AND a.d = p.trade_date"
_FAMILIES = {"factors_statement_plain": Plan(financial.PLAIN, financial.DEFS), "factors_statement": Plan(financial.COMPUTED, financial.DEFS)}


def statement_factors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = forms(FINANCIAL, "spark")
    got = relations(spark, sf_dir, text)
    return _FAMILIES[name].long(spark.sql(_with([f"{n} AS (SELECT * FROM {{{n}}})" for n in got], text), **got))


def statement_oracle(name: str) -> str:
    relation = forms(FINANCIAL, "duck").removeprefix("WITH ")
    pit, _, select = relation.partition(" SELECT p.*")
    head = f"{PANEL_SQL.strip()}, st AS ({ST['duck']}), {pit}, fin AS (SELECT p.*{select})"
    return _FAMILIES[name].long_sql(head, source="fin")


QUERIES = {k: (lambda spark, sf_dir, k=k: run(spark, sf_dir, k)) for k in TEXTS}
ORACLES = {k: oracle(k) for k in TEXTS}
QUERIES["crowd_temperature"] = temperature
QUERIES |= {k: (lambda spark, sf_dir, k=k: statement_factors(spark, sf_dir, k)) for k in _FAMILIES}
ORACLES |= {k: statement_oracle(k) for k in _FAMILIES}
