"""Queries of versioned dimensions: the priority a customer has by its orders, laid over one another in two batches.

The twins expand every day and never cut an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources import dimensions
from panelforge.sources.panel import read

KEYS, VALUES = ["symbol"], ["grade"]


def batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Each order makes its customer's grade valid for 90 days (urgent ones end it); two batches by order number."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("symbol"), F.substring("o_orderpriority", 1, 1).alias("grade"), (F.substring("o_orderpriority", 1, 1) == "1").alias("gone"),
        F.col("o_orderdate").cast("date").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), 90).alias("end"), F.col("o_orderkey").alias("seq"),
    )
    return [o.where(F.col("seq") % 2 == k) for k in (0, 1)]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = batches(spark, sf_dir)
    empty = first.select(*KEYS, *VALUES, "start", "end").limit(0)
    return dimensions.upsert(dimensions.upsert(empty, first, KEYS, VALUES), second, KEYS, VALUES)


def with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the first half of 1995 for every third customer: those with an even number have grade 9, the others none; other days stay."""
    table = history(spark, sf_dir)
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.lit("9").alias("grade")).where("symbol % 2 = 0")
    out = dimensions.snapshot(table, members, KEYS, VALUES, "symbol % 3 = 0", "1995-01-01", "1995-07-01")
    return out.select("symbol", "grade", "start", "end")


def _days(extra: str = "") -> str:
    day = lambda k: f"""b{k} AS (SELECT o_custkey AS symbol, substr(o_orderpriority, 1, 1) AS grade, CAST(o_orderdate AS DATE) AS s, o_orderkey AS q FROM orders WHERE o_orderkey % 2 = {k}
      QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1),
  d{k} AS (SELECT symbol, day, grade FROM (SELECT symbol, grade, s, CAST(unnest(generate_series(s, s + INTERVAL 89 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM b{k}) QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY s DESC) = 1)"""  # noqa: E731
    return f"""WITH {day(0)}, {day(1)},
  a AS (SELECT symbol, day, coalesce(d1.grade, d0.grade) AS grade FROM d1 FULL JOIN d0 USING (symbol, day)),
  g AS (SELECT * FROM a WHERE grade <> '1'{extra}),
  r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY symbol, grade ORDER BY day) AS INTEGER) AS run FROM g)
  SELECT symbol, grade, min(day) AS start, max(day) + 1 AS "end" FROM r GROUP BY symbol, grade, run"""


_LIST = """ AND NOT (symbol % 3 = 0 AND day >= DATE '1995-01-01' AND day < DATE '1995-07-01')
    UNION ALL SELECT c_custkey, CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-06-30', INTERVAL 1 DAY)) AS DATE), '9' FROM customer WHERE c_custkey % 6 = 0"""
QUERIES = {"dimension_upsert": history, "dimension_snapshot": with_snapshot}
ORACLES = {"dimension_upsert": _days(), "dimension_snapshot": _days(_LIST)}
