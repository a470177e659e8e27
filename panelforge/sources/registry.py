"""Dataset registry: what is installed, what a new configuration asks for, and from which day each dataset is loaded.

A configuration is a table of (name, kind, fields, members, settings): ``kind`` is ``panel`` for datasets that share the market table,
``side`` for tables of their own; ``members`` are the listed indices; ``settings`` a map of strings.  Comparisons are one join of two such tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.sources.dimensions import Dimension

# fixed values: columns that identify rows and are no data of their own
KEYS = ["ts_code", "trade_date", "symbol", "date", "index_code", "con_code", "l1_code", "l2_code", "l3_code", "in_date", "out_date", "ann_date", "end_date"]
SCHEMA = "name string, kind string, fields array<string>, members array<string>, settings map<string,string>"


def _list(c: str) -> Column:
    return F.coalesce(F.array_compact(F.array_distinct(c)), F.array().cast("array<string>"))


def normal(config: DataFrame) -> DataFrame:
    """One row a name: null lists empty, key columns no fields, settings without secrets (any key ``token``); a null kind is ``panel``. Of repeated names the greatest row by content stays."""
    rows = config.where("name IS NOT NULL").select(
        "name", F.coalesce("kind", F.lit("panel")).alias("kind"), F.sort_array(F.array_except(_list("fields"), F.array(*map(F.lit, KEYS)))).alias("fields"), F.sort_array(_list("members")).alias("members"),
        F.map_filter(F.coalesce("settings", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k) != "token").alias("settings"),
    )
    w = Window.partitionBy("name").orderBy(F.desc("kind"), F.desc("fields"), F.desc("members"), F.to_json("settings"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def diff(previous: DataFrame, current: DataFrame, present: DataFrame | None = None, empty: bool = False) -> DataFrame:
    """(name, action, fields, members) that bring ``previous`` to ``current``.

    ``install`` loads history: a new dataset or a side table with other settings, fields or members as a whole; of a panel dataset only the new fields, or only the new members with
    all fields, or both as a whole.  ``present``(name, member) tells which members have rows; listed ones without are loaded again.  ``drop_fields`` and ``remove`` take away.  Into an
    ``empty`` store panel datasets come by the rebuild of the market table, so that only side tables are installed and nothing is removed.
    """
    entries = lambda c: F.sort_array(F.map_entries(c))
    side = lambda f, s: normal(f).select("name", *(F.col(c).alias(f"{c}_{s}") for c in ("kind", "fields", "members")), entries("settings").alias(f"settings_{s}"))
    if empty:
        return side(current, "n").where("kind_n = 'side'").select("name", F.lit("install").alias("action"), F.col("fields_n").alias("fields"), F.col("members_n").alias("members"))
    both = side(previous, "o").join(side(current, "n"), "name", "full")
    if present is not None:
        both = both.join(present.where("member IS NOT NULL").groupBy("name").agg(F.collect_set("member").alias("have")), "name", "left")
    none = F.array().cast("array<string>")
    have = F.array_intersect("members_o", F.coalesce("have", none)) if present is not None else F.col("members_o")
    more, listed, less = F.array_except("fields_n", "fields_o"), F.array_except("members_n", have), F.array_except("fields_o", "fields_n")
    panel = F.col("kind_n").eqNullSafe(F.lit("panel")) & F.col("kind_o").eqNullSafe(F.lit("panel"))
    fresh = F.col("kind_o").isNull() | (F.col("kind_o") != F.col("kind_n"))
    other = ~F.struct("settings_n", "fields_n", "members_n").eqNullSafe(F.struct(F.col("settings_o").alias("settings_n"), F.col("fields_o").alias("fields_n"), F.col("members_o").alias("members_n")))
    step = lambda action, fields, members: F.struct(F.lit(action).alias("action"), fields.alias("fields"), members.alias("members"))
    whole = step("install", F.col("fields_n"), F.col("members_n"))
    load = F.when(F.col("kind_n").isNull(), None).when(fresh | (~panel & other), whole)
    load = load.when(panel & (F.size(more) > 0) & (F.size(listed) > 0), whole).when(panel & (F.size(more) > 0), step("install", more, F.col("members_n"))).when(panel & (F.size(listed) > 0), step("install", F.col("fields_n"), listed))
    gone = F.when(F.col("kind_n").isNull() | (F.col("kind_o") != F.col("kind_n")), step("remove", F.col("fields_o"), F.col("members_o"))).when(panel & (F.size(less) > 0), step("drop_fields", less, none))
    return both.select("name", F.explode(F.array_compact(F.array(load, gone))).alias("s")).select("name", "s.*")


def windows(datasets: DataFrame, marks: DataFrame, overlap: int = 3) -> DataFrame:
    """(name, mode, start) for ``datasets``(name, policy, asked) and ``marks``(name, last).

    ``always``: full each time.  ``static``: skipped once it has rows, unless ``asked`` is full.  ``resumed``: incremental from its last day wherever it has rows, asked for or not.
    ``announced``: incremental from ``overlap`` days before its last day, since announcements are corrected; full if asked.  ``listed``: incremental, from no day.
    Without rows, or with any other policy, full.
    """
    d = datasets.join(marks.groupBy("name").agg(F.max("last").alias("last")), "name", "left")
    policy, last = F.col("policy"), F.col("last").cast("date")
    full = last.isNull() | ~F.coalesce(policy.isin("static", "resumed", "announced", "listed"), F.lit(False)) | (F.col("asked").eqNullSafe(F.lit("full")) & (policy != "resumed"))
    mode = F.when(full, "full").when(policy == "static", "skip").otherwise("incremental")
    start = F.when(policy == "resumed", last).when(policy == "announced", F.date_sub(last, overlap))
    return d.select("name", mode.alias("mode"), F.when(mode == "incremental", start).alias("start"))


class Registry:
    """The installed configuration on disk, a version a write; the newest finished one is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Dimension(spark, path, ["name"], ["kind", "fields", "members", "settings", "action", "updated"])

    def read(self) -> DataFrame:
        rows = self.store.read()
        return rows if rows is not None else self.spark.createDataFrame([], SCHEMA + ", action string, updated timestamp")

    def _write(self, rows: DataFrame) -> None:
        self.store.write(rows.coalesce(1))

    def register(self, config: DataFrame, action: str = "install") -> None:
        """Adds or replaces datasets; fields that a panel dataset had before stay beside the new ones."""
        old = self.read()
        had = old.where("kind = 'panel'").select("name", F.col("fields").alias("_had"))
        new = normal(config).join(had, "name", "left").withColumn("fields", F.when(F.col("kind") == "panel", F.sort_array(F.array_union("fields", F.coalesce("_had", F.array().cast("array<string>"))))).otherwise(F.col("fields"))).drop("_had")
        new = new.withColumn("action", F.lit(action)).withColumn("updated", F.current_timestamp())
        self._write(old.join(new.select("name"), "name", "left_anti").unionByName(new))

    def unregister(self, names: list[str]) -> None:
        self._write(self.read().where(~F.col("name").isin(names)))

    def drop_fields(self, name: str, fields: list[str]) -> None:
        self._write(self.read().withColumn("fields", F.when(F.col("name") == name, F.array_except("fields", F.lit(fields))).otherwise(F.col("fields"))))

    def replace(self, config: DataFrame, action: str = "snapshot") -> None:
        """The registry as ``config`` says, nothing else."""
        self._write(normal(config).withColumn("action", F.lit(action)).withColumn("updated", F.current_timestamp()))

    def clear(self) -> None:
        self._write(self.read().limit(0))
