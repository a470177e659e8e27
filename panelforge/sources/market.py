"""The market table: one row a symbol and session, any number of fields, written by year and read by field, range and symbol.

Fields live in a small versioned table of their own, so that a new field needs no rewrite, a dropped one is gone at once and a field
added again after a drop does not bring old values back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.dimensions import Dimension

# fixed values: fields that an adjustment factor scales, and the column that holds it
PRICES = ("open", "high", "low", "close", "pre_close", "up_limit", "down_limit")
VOLUMES = ("vol",)
FACTOR = "adj_factor"
KEYS = ("symbol", "trade_date")


def is_index(symbol: Column) -> Column:
    return F.startswith(symbol, F.lit("index_"))


def select_market(table: DataFrame, fields: list[str] | None = None, start=None, end=None, symbols: list[str] | None = None, include_indexes: bool = False, adjust: str = "none") -> DataFrame:
    """(symbol, trade_date, fields) of a market table; range and symbols reach the scan, unused columns don't.

    ``hfq`` multiplies prices and divides volumes by the factor; index rows have factor 1; where a share's factor is missing or not positive, its scaled fields are null, never raw.
    No symbols (none or an empty list) means all.  Fields that are not there, a missing factor column and other modes are errors.
    """
    if adjust not in ("none", "hfq"):
        raise ValueError(f"unknown adjustment {adjust!r}")
    have = [c for c in table.columns if c not in (*KEYS, "year")]
    fields = sorted(have) if fields is None else list(fields)
    if missing := sorted(set(fields) - set(have)):
        raise ValueError(f"no such fields: {', '.join(missing)}")
    scaled = adjust == "hfq" and bool(set(fields) & {*PRICES, *VOLUMES})
    if scaled and FACTOR not in have:
        raise ValueError(f"adjusted prices need {FACTOR}")
    rows = table
    for day, beyond in ((start, lambda d: F.col("trade_date") >= d), (end, lambda d: F.col("trade_date") <= d)):
        rows = rows.where(beyond(F.lit(day).cast("date"))) if day is not None else rows
    if "year" in table.columns:  # the partitions
        rows = rows.where(F.col("year") >= F.year(F.lit(start).cast("date"))) if start is not None else rows
        rows = rows.where(F.col("year") <= F.year(F.lit(end).cast("date"))) if end is not None else rows
    rows = rows if include_indexes else rows.where(~is_index(F.col("symbol")))
    rows = rows.where(F.col("symbol").isin(list(symbols))) if symbols else rows
    factor = F.when(is_index(F.col("symbol")), 1.0).when(F.col(FACTOR) > 0, F.col(FACTOR)) if scaled else None
    value = lambda c: F.col(c) * factor if scaled and c in PRICES else F.try_divide(F.col(c), factor) if scaled and c in VOLUMES else F.col(c)
    return rows.select(*KEYS, *(value(c).alias(c) for c in fields))


class MarketTable:
    """A market table on disk, partitioned by year."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._names = Dimension(spark, f"{self.path}.fields", ["field"], ["physical", "type", "dropped"])

    def _known(self) -> list:
        rows = self._names.read()
        return rows.collect() if rows is not None else []  # one row a field

    def fields(self) -> list[str]:
        return sorted(r.field for r in self._known() if not r.dropped)

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        """Every row, with ``year``; no file is opened to learn the schema."""
        live = [r for r in self._known() if not r.dropped]
        shape = ", ".join(["symbol string", "trade_date date", *(f"`{r.physical}` {r.type}" for r in live), "year int"])
        p, fs = self._path(self.path)
        stored = self.spark.read.schema(shape).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], shape)
        return stored.select(*KEYS, *(F.col(r.physical).alias(r.field) for r in live), "year")

    def read(self, *args, **kwargs) -> DataFrame:
        return select_market(self.rows(), *args, **kwargs)

    def _declare(self, kinds: dict[str, str]) -> None:
        known = self._known()
        live = {r.field: r for r in known if not r.dropped}
        for f, t in kinds.items():
            if f in live and live[f].type != t:
                raise ValueError(f"field {f} is {live[f].type}, not {t}")
        fresh = [(f, f"{f}__{sum(r.field == f for r in known)}", t, False) for f, t in kinds.items() if f not in live]
        if fresh:
            self._write_names([tuple(r) for r in known] + fresh)

    def _write_names(self, rows: list[tuple]) -> None:
        self._names.write(self.spark.createDataFrame(rows, "field string, physical string, type string, dropped boolean").coalesce(1))

    def _publish(self, rows: DataFrame, years: list[int]) -> None:
        """``rows`` in place of these years: staged first, since what is replaced is read; years left without rows go."""
        stage = f"{self.path}.stage-{uuid.uuid4().hex}"
        physical = {r.field: r.physical for r in self._known() if not r.dropped}
        rows.select(*KEYS, *(F.col(f).alias(p) for f, p in physical.items()), F.year("trade_date").alias("year")).write.parquet(stage)
        done = self.spark.read.parquet(stage)
        left = {r[0] for r in done.select("year").distinct().collect()}  # years
        done.repartition("year", F.month("trade_date")).sortWithinPartitions("symbol", "trade_date").write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for gone in [stage, *(f"{self.path}/year={y}" for y in years if y not in left)]:
            p, fs = self._path(gone)
            fs.delete(p, True)

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Lays ``rows`` over the table: values win over what is stored, nulls don't.

        Of rows that repeat in the batch a field's last value by ``order`` counts, without an order its greatest.  Rows with a null key are ignored.  Only the years of the
        batch are rewritten; one aggregation meets old and new, no join.
        """
        new = rows.where("symbol IS NOT NULL AND trade_date IS NOT NULL").withColumn("trade_date", F.col("trade_date").cast("date")).withColumn("symbol", F.col("symbol").cast("string"))
        kinds = {c: t for c, t in new.dtypes if c not in (*KEYS, "year", order)}
        self._declare(kinds)
        years = [r[0] for r in new.select(F.year("trade_date")).distinct().collect()]  # years
        if not years:
            return
        names = self.fields()
        kind = {r.field: r.type for r in self._known() if not r.dropped}
        place = lambda layer, c: F.struct(F.lit(layer).alias("layer"), c.alias("at"))
        at = {c: F.col(order) if order else F.col(c) for c in kinds}
        over = new.select(*KEYS, *(F.struct(place(1, at[c]).alias("p"), F.col(c).alias("v")).alias(c) if c in kinds else F.lit(None).alias(c) for c in names))
        under = self.rows().where(F.col("year").isin(years)).select(*KEYS, *(F.struct(place(0, F.lit(None).cast(_type(new, order) if order else kind[c])).alias("p"), F.col(c).alias("v")).alias(c) if c in kinds else F.struct(F.col(c).alias("v")).alias(c) for c in names))
        both = under.unionByName(over.select(*KEYS, *(c if c in kinds else F.lit(None).cast(under.schema[c].dataType).alias(c) for c in names)))
        pick = lambda c: F.max_by(F.col(c)["v"], F.when(F.col(c)["v"].isNotNull(), F.col(c)["p"])) if c in kinds else F.max(F.col(c)["v"])
        self._publish(both.groupBy(*KEYS).agg(*(pick(c).alias(c) for c in names)), years)

    def delete_symbols(self, symbols: list[str]) -> None:
        hit = self.rows().where(F.col("symbol").isin(symbols))
        years = [r[0] for r in hit.select("year").distinct().collect()]
        if years:
            self._publish(self.rows().where(F.col("year").isin(years) & ~F.col("symbol").isin(symbols)), years)

    def drop_fields(self, fields: list[str]) -> list[str]:
        """Takes fields away; keys and unknown names are passed over. Their bytes go when a year is next written."""
        gone = sorted(set(fields) & set(self.fields()))
        if gone:
            self._write_names([(r.field, r.physical, r.type, r.dropped or r.field in gone) for r in self._known()])
        return gone

    def trade_dates(self, start=None, end=None) -> DataFrame:
        return self.read([], start, end).select("trade_date").distinct()

    def instruments(self) -> DataFrame:
        return self.read([], include_indexes=True).groupBy("symbol").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))


def _type(rows: DataFrame, column: str) -> str:
    return dict(rows.dtypes)[column]
