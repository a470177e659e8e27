"""Evaluation results: one Parquet partition a run and metric (trade_date, factor, value), with summaries and a catalogue of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResultStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, run: str, metric: str, rows: DataFrame) -> None:
        """Replaces one metric of one run."""
        out = rows.select("trade_date", "factor", F.col("value").cast("double"))
        out.sort("factor", "trade_date").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/run={run}/metric={metric}")

    def read(self, run: str | None = None, metric: str | None = None, factors: list[str] | None = None, start=None, end=None) -> DataFrame:
        """Long rows; run and metric prune folders."""
        df = self.spark.read.option("basePath", self.path).parquet(self.path)
        for column, value in (("run", run), ("metric", metric)):
            df = df.where(F.col(column) == value) if value is not None else df
        df = df.where(F.col("factor").isin(factors)) if factors is not None else df
        df = df.where(F.col("trade_date") >= F.lit(start)) if start is not None else df
        return df.where(F.col("trade_date") <= F.lit(end)) if end is not None else df

    def factors(self, run: str, contains: str = "") -> DataFrame:
        return self.read(run).where(F.lower("factor").contains(contains.lower())).select("factor").distinct()

    def summary(self, run: str) -> DataFrame:
        """Mean, sample deviation, their ratio, share above zero and count over the finite values of each factor and metric."""
        v = F.when(F.abs("value") < float("inf"), F.col("value"))
        std = F.stddev_samp("v")
        return self.read(run).select("factor", "metric", v.alias("v")).groupBy("factor", "metric").agg(
            F.avg("v").alias("mean"), std.alias("std"), F.try_divide(F.avg("v"), std).alias("ir"), F.avg((F.col("v") > 0).cast("double")).alias("positive"), F.count("v").alias("n"),
        )

    def correlation_subset(self, matrix: DataFrame, names: list[str]) -> DataFrame:
        """The pairs (f1, f2, corr) of a library matrix among ``names``."""
        return matrix.where(F.col("f1").isin(names) & F.col("f2").isin(names))

    def runs(self) -> DataFrame:
        return self.read().groupBy("run").agg(F.countDistinct("metric").alias("metrics"), F.countDistinct("factor").alias("factors"), F.max("trade_date").alias("last_date"))

    def delete(self, run: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={run}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_json(rows: DataFrame, path: str) -> None:
    """Order plans, snapshots and run descriptions as JSON lines; NaN and infinities become null, nulls are written."""
    clean = [F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
