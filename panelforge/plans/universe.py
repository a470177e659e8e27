"""Queries of the market table and of the universes as functions of their inputs; the twins are plain joins written apart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.plans.expression import clean, sql_clean
from panelforge.sources import universes
from panelforge.sources.market import MarketTable
from panelforge.sources.panel import PANEL_SQL, dense, read
from panelforge.sources.stage import discard, shared_dir, staged

HEADS = ("SH60", "SZ00", "SZ300", "SH688", "BJ83", "SH90")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a code a symbol by rule, since the tables have none."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), F.pmod("symbol", F.lit(len(HEADS))).cast("int") + 1)
    return dense(spark, sf_dir).withColumn("code", F.concat(head, F.lpad(F.col("symbol").cast("string"), 6, "0")))


def market_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries (a later one without opens, which amends closes and brings a factor) and index rows, read back adjusted from 1996 on."""
    p = staged(coded(spark, sf_dir).where("close IS NOT NULL").select("code", "trade_date", "t", "open", "high", "close", "vol", "l1"))  # every upsert reads its batch twice
    table = MarketTable(spark, f"{shared_dir(spark)}/market-{uuid.uuid4().hex}")
    table.upsert(p.where("t < 50").select(F.col("code").alias("symbol"), "trade_date", "open", "close", "vol"))
    later = p.where("t >= 40").select(F.col("code").alias("symbol"), "trade_date", F.lit(None).cast("double").alias("open"), F.col("high").alias("close"), "vol", F.when(F.col("vol") > 60, 1 + F.col("t") / 100).alias("adj_factor"))
    table.upsert(later)
    levels = p.groupBy("l1", "trade_date").agg(F.max("close").alias("close")).select(F.concat(F.lit("index_"), "l1").alias("symbol"), "trade_date", "close")
    table.upsert(levels)
    discard(p)
    out = table.read(["open", "close", "vol"], "1996-01-01", None, None, True, "hfq")
    return out.select("symbol", "trade_date", *(clean(F.col(c)).alias(c) for c in ("open", "close", "vol")))


def every_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen; the k-th index holds the 10 k largest of every sixth session from the k-th on."""
    p = coded(spark, sf_dir).where("close IS NOT NULL")
    ranked = p.where("mv IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("mv"), "symbol")))
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("index_code")) for i, c in enumerate(universes.INDEX.values()))))
    held = ranked.select("code", "trade_date", "t", "k", place.alias("x")).where("t % 6 = x.i % 6 AND k <= 10 * (x.i + 1)").select("x.index_code", "code", "trade_date")
    return universes.labelled(p.select("code", "trade_date"), held).select("code", "trade_date", F.explode("universes").alias("universe"))


def buyable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules: a share is restricted for 200 days from its lowest close, listed by its first bar, delisted by its last one where the account is in debt."""
    p = coded(spark, sf_dir)
    seen = p.where("close IS NOT NULL")
    lows = seen.groupBy("code").agg(F.min_by("trade_date", F.struct("close", "trade_date")).alias("start"))
    names = lows.select("code", F.lit("*ST low").alias("name"), "start", F.date_add("start", 200).alias("end")).unionByName(lows.select("code", F.lit("Plain").alias("name"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")))
    debt = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") < 0).alias("debt"))
    basics = seen.groupBy("code", "symbol").agg(F.min("trade_date").alias("list_date"), F.max("trade_date").alias("last")).join(debt, "symbol", "left").select("code", "list_date", F.when(F.col("debt"), F.col("last")).alias("delist_date"))
    forms = [universes.investable(p, names, basics, 6, form).select("code", "trade_date", F.lit(kind).alias("entry")) for kind, form in (("open", False), ("next_open", True))]
    return forms[0].unionByName(forms[1])


_CODED = "coded AS (SELECT *, concat(CASE CAST(symbol % 6 AS INT) WHEN 0 THEN 'SH60' WHEN 1 THEN 'SZ00' WHEN 2 THEN 'SZ300' WHEN 3 THEN 'SH688' WHEN 4 THEN 'BJ83' ELSE 'SH90' END, lpad(CAST(symbol AS VARCHAR), 6, '0')) AS code FROM panel)"
_MARKET = f"""WITH {PANEL_SQL.strip()}, {_CODED},
  p AS (SELECT code, trade_date, t, CASE WHEN t < 50 THEN open END AS open, CASE WHEN t >= 40 THEN high ELSE close END AS close, vol, CASE WHEN t >= 40 AND vol > 60 THEN 1 + t / 100 END AS f, l1 FROM coded WHERE close IS NOT NULL)
  SELECT code AS symbol, trade_date, {sql_clean('open * f')} AS open, {sql_clean('close * f')} AS close, {sql_clean('vol / f')} AS vol FROM p WHERE trade_date >= DATE '1996-01-01'
  UNION ALL SELECT 'index_' || l1, trade_date, NULL, {sql_clean('max(close)')}, NULL FROM coded WHERE close IS NOT NULL AND trade_date >= DATE '1996-01-01' GROUP BY l1, trade_date"""
_EVERY = f"""WITH {PANEL_SQL.strip()}, {_CODED}, s AS (SELECT * FROM coded WHERE close IS NOT NULL),
  i AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(universes.INDEX))}) v(i, universe)),
  h AS (SELECT t, code, i, universe FROM (SELECT t, code, row_number() OVER (PARTITION BY t ORDER BY mv DESC, symbol) AS k FROM s WHERE mv IS NOT NULL) r JOIN i ON t % 6 = i % 6 AND k <= 10 * (i + 1))
  SELECT code, trade_date, 'all' AS universe FROM s
  UNION ALL SELECT code, trade_date, CASE CAST(symbol % 6 AS INT) WHEN 2 THEN 'gem' WHEN 3 THEN 'star' WHEN 4 THEN 'bse' ELSE 'main' END FROM s WHERE symbol % 6 <> 5
  UNION ALL SELECT s.code, s.trade_date, h.universe FROM s JOIN h ON h.code = s.code AND h.t = s.t - (s.t - h.i % 6 + 6) % 6"""
_BUY = f"""WITH {PANEL_SQL.strip()}, {_CODED}, seen AS (SELECT code, symbol, min(t) AS ipo, max(trade_date) AS last, arg_min(trade_date, (close, trade_date)) AS low_day FROM coded WHERE close IS NOT NULL GROUP BY code, symbol),
  r AS (SELECT c.*, lead(open) OVER w AS nxt, lead(c.trade_date) OVER w AS day FROM coded c WINDOW w AS (PARTITION BY symbol ORDER BY t)),
  ok AS (SELECT r.code, r.trade_date, open, nxt FROM r JOIN seen USING (code) JOIN supplier ON s_suppkey = r.symbol
    WHERE r.t >= ipo + 6 AND NOT (r.trade_date >= low_day AND r.trade_date <= low_day + 200) AND (NOT coalesce(s_acctbal < 0, false) OR day < last))
  SELECT code, trade_date, 'open' AS entry FROM ok WHERE open <> 0 UNION ALL SELECT code, trade_date, 'next_open' FROM ok WHERE nxt <> 0"""
QUERIES = {"market_table": market_table, "universe_every": every_universe, "universe_investable": buyable}
ORACLES = {"market_table": _MARKET, "universe_every": _EVERY, "universe_investable": _BUY}
