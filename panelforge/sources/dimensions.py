"""Versioned dimension tables: names, members, constituents, basics as disjoint intervals of a key.

A table has key columns, value columns, ``start`` and ``end`` (exclusive; null: still valid).  An upsert lays new intervals over the old ones: it
splits what it covers in part, keeps everything outside its own days, and merges neighbours with equal values.  It is one window
over a key's changes (one shuffle), whatever the number of versions, and needs no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trimmed(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals of one batch: each ends where the key's next one starts; of equal starts the larger ``seq`` stays; empty ones go."""
    same = Window.partitionBy(*keys, "start").orderBy(F.desc("seq"))
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    u = updates.where(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    u = u.withColumn("_place", F.row_number().over(same)).where("_place = 1")
    return u.withColumn("end", F.least("end", following)).drop("_place", "seq")  # least passes over nulls


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``table`` with the intervals of ``updates``(keys, values, gone, start, end, seq) laid over it; ``gone`` intervals end what was valid.

    Rows with a null key or start are ignored; nulls among the values are values.
    """
    known = lambda f: f.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    new = trimmed(known(updates), keys).select(*keys, F.lit(1).alias("_layer"), F.struct(F.lit(True).alias("on"), F.coalesce("gone", F.lit(False)).alias("gone"), *values).alias("_v"), "start", "end")
    old = known(table).select(*keys, F.lit(0).alias("_layer"), F.struct(F.lit(True).alias("on"), F.lit(False).alias("gone"), *values).alias("_v"), "start", "end")
    both = old.unionByName(new)
    off = F.struct(F.lit(False).alias("on"), F.lit(False).alias("gone"), *(F.lit(None).cast(both.schema["_v"].dataType[c].dataType).alias(c) for c in values))
    begins = both.select(*keys, "_layer", F.col("start").alias("_at"), F.lit(1).alias("_first"), "_v")
    ends = both.where("end is not null").select(*keys, "_layer", F.col("end").alias("_at"), F.lit(0).alias("_first"), off.alias("_v"))
    # at one time a layer's start counts before its end
    turn = lambda layer: F.max_by("_v", F.when(F.col("_layer") == layer, F.col("_first")))
    points = begins.unionByName(ends).groupBy(*keys, "_at").agg(turn(0).alias("_old"), turn(1).alias("_new"))
    w = Window.partitionBy(*keys).orderBy("_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    state = lambda c: F.last(c, ignorenulls=True).over(so_far)
    points = points.select(*keys, "_at", state("_old").alias("_old"), state("_new").alias("_new"))
    top = F.when(F.col("_new.on"), F.col("_new")).when(F.col("_old.on"), F.col("_old"))
    points = points.withColumn("_v", F.when(~top["gone"], top))
    changed: Column = ~F.col("_v").eqNullSafe(F.lag("_v").over(w))
    points = points.withColumn("_changed", F.coalesce(changed, F.lit(True))).where("_changed")
    return points.withColumn("end", F.lead("_at").over(w)).where("_v is not null").select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values), F.col("_at").alias("start"), "end")


def snapshot(table: DataFrame, members: DataFrame, keys: list[str], values: list[str], scope: str | Column, start, end=None) -> DataFrame:
    """``table`` after a whole list of ``members``(keys, values) was seen for the keys in ``scope``: valid from ``start`` up to ``end``, the next list's day.

    Keys of the scope that are not listed are gone in these days; other days and other keys stay as they are.
    """
    day = table.schema["start"].dataType
    at, until = F.lit(start).cast(day), F.lit(end).cast(day)
    scope = F.expr(scope) if isinstance(scope, str) else scope
    listed = members.where(scope).select(*keys, *values, F.lit(False).alias("gone"), at.alias("start"), until.alias("end"), F.lit(1).alias("seq"))
    absent = table.where(scope).select(*keys).distinct().join(members.select(*keys), keys, "left_anti")
    kinds = {c: table.schema[c].dataType for c in values}
    absent = absent.select(*keys, *(F.lit(None).cast(kinds[c]).alias(c) for c in values), F.lit(True).alias("gone"), at.alias("start"), until.alias("end"), F.lit(0).alias("seq"))
    return upsert(table, listed.unionByName(absent), keys, values)


def as_of(table: DataFrame, day) -> DataFrame:
    """Rows valid on a day (a value or a column)."""
    day = day if isinstance(day, Column) else F.lit(day)
    return table.where((F.col("start") <= day) & (F.col("end").isNull() | (F.col("end") > day)))


class Dimension:
    """A dimension on disk: every write is a folder of its own, read is the newest finished one, so a crash leaves the last version."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str]):
        self.spark, self.path, self.keys, self.values = spark, path, keys, values

    def _versions(self) -> list[int]:
        home = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(home):
            return []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(home)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def write(self, table: DataFrame) -> DataFrame:
        n = (self._versions() or [0])[-1] + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        return self.read()

    def upsert(self, updates: DataFrame) -> DataFrame:
        old = self.read()
        if old is None:
            old = updates.select(*self.keys, *self.values, "start", "end").limit(0)
        return self.write(upsert(old, updates, self.keys, self.values))
