"""The canonical dense panel (date x symbol) and its companions, from the supplied tables.

symbol = supplier, period = month of shipping, price = extended price / quantity; open and close are the first
and last by ship date and order, industry levels are the supplier's nation and region.  ``PANEL_SQL`` is the
same panel for DuckDB.  The grid is densified (every period x every symbol) before any window, because windows count
calendar rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with NaN and infinities of its floating columns as null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def bars(spark: SparkSession, sf_dir: str, lines: str = "true") -> DataFrame:
    """Sparse bars: one row a symbol and month with trades; of the ``lines`` that meet a condition."""
    li = read(spark, sf_dir, "lineitem").where(lines).select(
        F.col("l_suppkey").alias("symbol"), F.trunc("l_shipdate", "month").alias("trade_date"), F.try_divide("l_extendedprice", "l_quantity").alias("px"),
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("a"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"),
    )
    # first and last by key as plain partial aggregates: no sort, no list
    return li.groupBy("symbol", "trade_date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
        F.sum("q").alias("vol"), F.sum("a").alias("amount"),
    )


def densify(df: DataFrame, symbol: str = "symbol", date: str = "trade_date") -> DataFrame:
    """Every symbol x every date, missing bars null, and ``t``, the calendar position from 0.

    The calendar is a column of one row per symbol (an array of dates, as many as there are sessions), exploded
    beside the symbols: no Cartesian product of two tables.
    """
    cal = df.agg(F.sort_array(F.collect_set(date)).alias("cal"))
    grid = df.select(symbol).distinct().join(F.broadcast(cal)).select(symbol, F.posexplode("cal").alias("t", date))
    return grid.join(df, [symbol, date], "left")


def dense(spark: SparkSession, sf_dir: str, lines: str = "true") -> DataFrame:
    """The dense panel (of some ``lines``): symbol, trade_date, t, open, high, low, close, vol, amount, vwap, ret, mv, l1, l2, l3."""
    sup = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sup = sup.select(F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("l1"), F.col("s_nationkey").alias("l2"), (F.col("s_nationkey") % 3).alias("l3"), (F.abs("s_acctbal") + 1).alias("shares"))
    p = densify(bars(spark, sf_dir, lines)).join(sup, "symbol", "left")
    w = Window.partitionBy("symbol").orderBy("t")
    p = p.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)
    return p.select("symbol", "trade_date", "t", "open", "high", "low", "close", "vol", "amount", F.try_divide("amount", "vol").alias("vwap"), "ret", (F.col("close") * F.col("shares")).alias("mv"), "l1", "l2", "l3")


PANEL_SQL = """
bars AS (
  SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
    arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
    sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT trade_date FROM bars)),
grid AS (SELECT symbol, trade_date, t FROM (SELECT DISTINCT symbol FROM bars), cal),
panel AS (
  SELECT g.symbol, g.trade_date, g.t, open, high, low, close, vol, amount, amount / nullif(vol, 0) AS vwap,
    close / nullif(lag(close) OVER (PARTITION BY g.symbol ORDER BY g.t), 0) - 1 AS ret, close * (abs(s_acctbal) + 1) AS mv,
    n_regionkey AS l1, s_nationkey AS l2, s_nationkey % 3 AS l3
  FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.trade_date = g.trade_date
  LEFT JOIN supplier ON s_suppkey = g.symbol LEFT JOIN nation ON n_nationkey = s_nationkey)
"""
