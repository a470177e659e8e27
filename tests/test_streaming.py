"""Append-mode streams over files that arrive one after the other: late events, state that shrinks, restarts."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelforge.streaming import incremental

START = datetime(2024, 1, 1)


def arrive(spark, folder, rows):
    spark.createDataFrame([(u, START + timedelta(hours=h), float(v)) for u, h, v in rows], "user_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, work, make):
    q = incremental.append(make(spark.readStream.schema("user_id long, ts timestamp, value double").parquet(folder)), f"{work}/out", f"{work}/check")
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]]
    return spark.read.parquet(f"{work}/out"), rows


def test_late_events_and_state(spark, tmp_path):
    src, work = f"{tmp_path}/src", f"{tmp_path}/work"
    bars = lambda e: incremental.event_bars(e, "1 day")
    arrive(spark, src, [(u, h, 1) for u in range(5) for h in range(0, 48, 6)])
    run(spark, src, work, bars)
    arrive(spark, src, [(u, 24 * 9 + u, 1) for u in range(5)])  # the watermark passes the first days
    out, state = run(spark, src, work, bars)
    assert out.count() == 10 and out.agg(F.sum("n")).first()[0] == 40 and max(state) >= 10 and state[-1] == 5
    arrive(spark, src, [(0, 30, 100), (0, 24 * 9 - 20, 7)])  # nine days late: dropped; within the delay: kept
    run(spark, src, work, bars)
    arrive(spark, src, [(0, 24 * 20, 1)])
    out, state = run(spark, src, work, bars)
    got = {(r.user_id, r.w.start): r.total for r in out.collect()}
    assert got[0, START + timedelta(days=1)] == 4 and got[0, START + timedelta(days=8)] == 7 and state[-1] == 1
    whole = incremental.current(out, spark.read.parquet(src), bars).collect()
    assert len(whole) == len(got) + 1 and {(r.user_id, r.w.start) for r in whole} == got.keys() | {(0, START + timedelta(days=20))}


def test_sessions_close_after_the_gap(spark, tmp_path):
    src = f"{tmp_path}/src"
    arrive(spark, src, [(1, 0, 1), (1, 5, 2), (1, 30, 4), (2, 1, 8), (1, 200, 1)])
    out, state = run(spark, src, f"{tmp_path}/work", lambda e: incremental.user_sessions(e, "1 day", "12 hours"))
    assert sorted((r.user_id, r.n, r.total) for r in out.collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)] and state[-1] == 1
    whole = incremental.user_sessions(spark.read.parquet(src), gap="12 hours").collect()
    assert sorted((r.user_id, r.n) for r in whole) == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_repeats_within_the_watermark(spark, tmp_path):
    src, work = f"{tmp_path}/src", f"{tmp_path}/work"
    first = lambda e: incremental.deduplicated(e, ["user_id", "value"], "1 day")
    arrive(spark, src, [(1, 0, 1), (1, 0, 1), (1, 2, 2)])
    run(spark, src, work, first)
    arrive(spark, src, [(1, 3, 1), (2, 24 * 30, 1)])  # a repeat in a later file
    out, state = run(spark, src, work, first)
    assert sorted((r.user_id, r.value) for r in out.collect()) == [(1, 1.0), (1, 2.0), (2, 1.0)] and state[-1] == 1
    assert incremental.deduplicated(spark.read.parquet(src), ["user_id", "value"]).count() == 3
