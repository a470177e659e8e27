"""Event streams in append mode: a window is written once, when the watermark has passed it, and its state goes then.

Events later than ``delay`` behind the newest one seen are dropped.  ``current`` joins what the sink holds with the windows still open, so a
reader sees every event exactly once without the stream keeping closed windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.sources.stage import shared_dir


def marked(events: DataFrame, delay: str) -> DataFrame:
    """``events`` with ``ts`` as a timestamp, and a watermark if it is a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", delay) if events.isStreaming else e


def event_bars(events: DataFrame, delay: str = "2 days", window: str = "1 day") -> DataFrame:
    """(user_id, w, n, total, top): bars of each user from a stream or a table of events."""
    return marked(events, delay).groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))


def user_sessions(events: DataFrame, delay: str = "2 days", gap: str = "12 hours") -> DataFrame:
    """(user_id, w, n, total, top): runs of a user's events that follow each other within ``gap``."""
    return marked(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))


def deduplicated(events: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """First of the events with equal keys; a stream forgets a key ``delay`` after it was seen, so its state doesn't grow with time."""
    e = marked(events, delay)
    return e.dropDuplicatesWithinWatermark(keys) if events.isStreaming else e.dropDuplicates(keys)


def append(result: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes a streaming result to a folder of Parquet files, each window once; runs over what is there now and can be started again."""
    return result.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(closed: DataFrame, events: DataFrame, windowed, **options) -> DataFrame:
    """Closed windows of the sink and the open ones from ``events``: those that end after the last closed one.

    ``windowed``: ``event_bars`` or another function of events whose windows don't reach over the end of a closed one.
    """
    last = closed.agg(F.max("w.end").alias("last"))
    recent = events.crossJoin(F.broadcast(last)).where("last is null or cast(ts as timestamp) >= last").drop("last")  # one row
    return closed.unionByName(windowed(recent, **options))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events*.parquet")


def _run(spark: SparkSession, result: DataFrame) -> DataFrame:
    """The sink of a stream over everything that is there now."""
    here = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    append(result, f"{here}/out", f"{here}/checkpoint").awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{here}/out")


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of everything that is there now: closed ones from the stream's sink, open ones from the table."""
    out = current(_run(spark, event_bars(_source(spark, sf_dir))), spark.read.parquet(f"{sf_dir}/events.parquet"), event_bars)
    return out.select("user_id", F.col("w.start").cast("date").alias("d"), "n", "total", "top")


def run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions only: those that ended ``delay`` before the newest event."""
    return _run(spark, user_sessions(_source(spark, sf_dir))).select("user_id", F.col("w.start").alias("start"), "n", "total", "top")


def run_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without repeats of (user, time), counted by day from the sink of the stream."""
    seen = _run(spark, deduplicated(_source(spark, sf_dir), ["user_id", "ts"]).select("user_id", "ts"))
    return seen.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
