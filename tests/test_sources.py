"""Universes and the result store."""

import datetime as dt

import pytest

from panelforge.sources import universes
from panelforge.sources.results import ResultStore, write_json


def day(n):
    return dt.date(2020, 1, n)


def test_boards_and_names(spark):
    from pyspark.sql import functions as F

    want = {"SH600000": "main", "SZ000001": "main", "SZ300750": "gem", "SZ301001": "gem", "SH688001": "star", "BJ920227": "bse", "SZ830001": "bse", "SH900901": "other"}
    df = spark.createDataFrame([(c,) for c in want] + [(None,)], "code string")
    got = {r[0]: r[1] for r in df.select("code", universes.board(F.col("code"))).collect()}
    assert got == want | {None: None}
    names = spark.createDataFrame([("ST A",), ("*A",), ("A退",), ("Aa",), (None,)], "n string")
    assert [r[0] for r in names.select(universes.restricted(F.col("n"))).collect()] == [True, True, True, False, False]


def test_index_membership_as_of(spark):
    panel = spark.createDataFrame([(c, day(d)) for c in "ab" for d in range(1, 6)], "code string, trade_date date")
    held = spark.createDataFrame([("000300.SH", "a", day(2)), ("000300.SH", "b", day(4)), ("000905.SH", "a", day(1))], "index_code string, code string, trade_date date")
    got = {(r[0], r[1].day) for r in universes.members(panel, "hs300", held).collect()}
    assert got == {("a", 2), ("a", 3), ("b", 4), ("b", 5)}
    with pytest.raises(ValueError):
        universes.members(panel, "sz50", held)
    with pytest.raises(ValueError):
        universes.members(panel, "none", held)


def test_benchmarks():
    assert universes.benchmark("000905.SH", ["000300.SH", "000510.SH"]) == "000510.SH"
    assert universes.benchmark("000905.SH", []) == "000905.SH"
    assert universes.benchmark(None, ["000300.SH", "000001.SH"]) == "000300.SH"
    assert universes.default_benchmark("gem") == "399006.SZ" and len(universes.NAMES) == 13


def test_result_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(day(1), "x_1", 1.0), (day(2), "x_1", -3.0), (day(1), "y", float("nan"))], "trade_date date, factor string, value double")
    store.write("one", "ic", rows)
    store.write("one", "rank_ic", rows.where("factor = 'y'"))
    store.write("two", "ic", rows)
    assert [r[0] for r in store.factors("one", "X").collect()] == ["x_1"]
    got = {(r["factor"], r["metric"]): r for r in store.summary("one").collect()}
    assert got["x_1", "ic"]["mean"] == -1.0 and got["x_1", "ic"]["positive"] == 0.5 and got["x_1", "ic"]["n"] == 2
    assert got["y", "rank_ic"]["mean"] is None and got["y", "rank_ic"]["n"] == 0
    assert store.read("two", "ic", ["x_1"], day(2), day(2)).count() == 1
    store.delete("two")
    assert [r["run"] for r in store.runs().collect()] == ["one"]
    write_json(rows, str(tmp_path / "j"))
    assert '"value":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_registry_builds_the_panel_once(spark):
    from panelforge.plans.panel_queries import universe_registry

    plan = universe_registry(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan  # every universe reads the written panel, none the lines again
