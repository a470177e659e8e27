"""Reading tables and cutting lineage through the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes the shuffle files of a query when it ends, not when the driver's garbage collector finds them unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where the setting is unset, a local run makes a temporary one and a cluster is an error."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not here:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        here = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(here)
    return here


def staged(df: DataFrame, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: survives lost executors and cuts the lineage.

    ``done``: staged tables that nothing reads once this one is written; their folders go, and so do the shuffle files of this
    write.  The folders that a returned result still reads stay until the caller empties the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for frame in done:
        discard(frame)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(frame: DataFrame) -> None:
    """Deletes the folder of a staged table."""
    spark = frame.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.staged_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lower_ascii(c):
    """A-Z to a-z, everything else as it is (``lower`` would also change other letters)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Distributed union-find: (a, b) links -> (id, root) with the smallest id of each component, for linked ids other than the roots.

    Alternating large-star and small-star steps until every component is one star; each step is a shuffle that pre-aggregates, no
    group is gathered.  Null ends are ignored; no links give an empty result.
    """
    e = staged(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # a star forest: every id has one link to a smaller one at most, and none that others link to has one
        ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if loose.isEmpty():
            out = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
            out.staged_path = e.staged_path
            return out
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
        e = staged(small.union(down.select("a", F.col("m").alias("b"))).distinct(), done=(e,))
    raise RuntimeError("union-find did not settle")
