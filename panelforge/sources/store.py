"""Factor store: long Parquet (trade_date, symbol, value) partitioned by factor.

Appends and patches rewrite only the partitions of the factors written (dynamic partition overwrite); new rows are staged
before the overwrite, since a partition cannot be read while it is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("trade_date", "symbol", "value", "factor")


class FactorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path).select(*COLUMNS)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _publish(self, df: DataFrame) -> None:
        stage = f"{self.path}.stage-{uuid.uuid4().hex}"
        df.write.parquet(stage)
        rows = self.spark.read.parquet(stage)
        rows.repartition("factor", F.substring(F.col("trade_date").cast("string"), 1, 4)).sortWithinPartitions("trade_date", "symbol").write.partitionBy("factor").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def write(self, df: DataFrame, mode: str = "patch") -> None:
        """``append``: only dates after a factor's last; ``patch``: new rows win, old ones stay; ``replace``: the factors' history anew.

        A factor without any value is refused.
        """
        df = df.select(*COLUMNS)
        empty = df.groupBy("factor").agg(F.count("value").alias("n")).where("n = 0").select("factor").take(1)
        if empty:
            raise ValueError(f"factor without values: {empty[0][0]}")
        old = self._all()
        if old is None or mode == "replace":
            return self._publish(df)
        old = old.join(df.select("factor").distinct(), "factor", "left_semi").select(*COLUMNS)
        if mode == "append":
            last = old.groupBy("factor").agg(F.max("trade_date").alias("last"))
            df = df.join(last, "factor", "left").where("last is null or trade_date > last").select(*COLUMNS)
        both = old.withColumn("_new", F.lit(0)).unionByName(df.withColumn("_new", F.lit(1)))
        w = Window.partitionBy("factor", "trade_date", "symbol").orderBy(F.desc("_new"))
        return self._publish(both.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*COLUMNS))

    def read(self, factors: list[str] | None = None, start=None, end=None, symbols: list | None = None) -> DataFrame:
        """Long rows with values; partitions and row groups are pruned by the filters."""
        df = self.spark.read.parquet(self.path).where(F.col("value").isNotNull())
        for column, values in (("factor", factors), ("symbol", symbols)):
            df = df.where(F.col(column).isin(values)) if values is not None else df
        df = df.where(F.col("trade_date") >= F.lit(start)) if start is not None else df
        return df.where(F.col("trade_date") <= F.lit(end)) if end is not None else df

    def watermark(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("factor").agg(F.max("trade_date").alias("last_date"))

    def trim_from(self, day) -> None:
        """Takes out all rows from ``day`` on; a factor that has none before goes altogether."""
        rows = self._all()
        if rows is None:
            return
        first = rows.groupBy("factor").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
        gone = [r[0] for r in first.where(F.col("first") >= F.lit(day)).select("factor").collect()]  # names of factors
        cut = first.where((F.col("first") < F.lit(day)) & (F.col("last") >= F.lit(day))).select("factor")
        self._publish(rows.join(cut, "factor", "left_semi").where(F.col("trade_date") < F.lit(day)).select(*COLUMNS))
        self.purge(gone)

    def purge(self, factors: list[str]) -> None:
        for f in factors:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/factor={f}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
