"""Tables written once and read again through the shared folder of ``spark.checkpoint.dir``: cut lineage, survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query when it ends, not when the driver's garbage collector finds them unused.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


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


def staged(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/panelforge-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(frame: DataFrame) -> None:
    """Deletes the folder of a staged table."""
    spark = frame.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.staged_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
