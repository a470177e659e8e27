"""Expanding ratios of mean to deviation of any daily metric: the rank form over the holding return, the distance correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.plans import evaluation, kernels
from panelforge.plans.expression import clean, sql_clean


def expanding_ratio(rows: DataFrame, value: str) -> DataFrame:
    """(trade_date, factor, ratio): mean over sample deviation of a factor's values up to the day; null with fewer than two values or none that differ.

    Days without a value keep the ratio before them.
    """
    w = Window.partitionBy("factor").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    ratio = F.when((F.count(x).over(w) > 1) & (F.var_samp(x).over(w) > 1e-30), F.try_divide(F.avg(x).over(w), F.stddev_samp(x).over(w)))
    return rows.select("trade_date", "factor", clean(ratio).alias("ratio"))


def rank_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanding_ratio(evaluation.QUERIES["metric_rank_ic_hold"](spark, sf_dir), "rank_ic_hold")


def nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanding_ratio(kernels.QUERIES["kernel_nonlinear_ic"](spark, sf_dir), "dcor")


def _twin(text: str, value: str) -> str:
    """Every day's own list of days up to it."""
    return f"""WITH m AS ({text}) SELECT a.trade_date, a.factor, {sql_clean(f"CASE WHEN count(b.{value}) > 1 AND var_samp(b.{value}) > 1e-30 THEN avg(b.{value}) / stddev_samp(b.{value}) END")} AS ratio
  FROM m a JOIN m b ON b.factor = a.factor AND b.trade_date <= a.trade_date GROUP BY a.trade_date, a.factor"""


QUERIES = {"metric_rank_icir_hold": rank_hold, "metric_nonlinear_icir": nonlinear}
ORACLES = {"metric_rank_icir_hold": _twin(evaluation.ORACLES["metric_rank_ic_hold"], "rank_ic_hold"), "metric_nonlinear_icir": _twin(kernels.ORACLES["kernel_nonlinear_ic"], "dcor")}
