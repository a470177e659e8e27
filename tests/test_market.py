"""Market table on disk and universes as functions, by hand-worked cases and twins."""

from datetime import date

import duckdb
import pandas as pd
import pytest
from test_queries import SF, canon

from panelforge.plans import universe
from panelforge.sources import universes
from panelforge.sources.market import MarketTable, select_market

D = lambda m, d=1, y=2024: date(y, m, d)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_upserts_fields_and_reads(spark, tmp_path):
    m = MarketTable(spark, f"{tmp_path}/market")
    assert m.fields() == [] and m.read().count() == 0
    make = lambda data, extra: spark.createDataFrame(data, "symbol string, trade_date date, " + extra)
    m.upsert(make([("a", D(1), 10.0, 5.0), ("a", D(2, y=2023), 9.0, 4.0), ("b", D(1), None, 2.0), (None, D(1), 1.0, 1.0), ("c", None, 1.0, 1.0)], "close double, vol double"))
    m.upsert(make([("a", D(1), None, 2.0, 1), ("b", D(1), 7.0, None, 1), ("b", D(1), 6.0, 0.5, 2), ("index_x", D(1), 3.0, None, 1)], "close double, adj_factor double, seq int"), "seq")
    assert m.fields() == ["adj_factor", "close", "vol"]
    assert rows(m.read(["close", "vol"]), "symbol", "close", "vol") == [("a", 10.0, 5.0), ("a", 9.0, 4.0), ("b", 6.0, 2.0)]
    assert rows(m.read(["close", "vol"], adjust="hfq", include_indexes=True), "symbol", "close", "vol") == [("a", 20.0, 2.5), ("a", None, None), ("b", 3.0, 4.0), ("index_x", 3.0, None)]
    assert rows(m.read(["vol"], "2024-01-01", "2024-01-31", ["a"]), "symbol", "vol") == [("a", 5.0)]
    plan = m.read(["vol"], "2024-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "close" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert m.drop_fields(["vol", "symbol", "none"]) == ["vol"] and m.fields() == ["adj_factor", "close"]
    m.upsert(make([("b", D(1), 8.0)], "vol double"))
    assert rows(m.read(["vol"]), "symbol", "vol") == [("a", None), ("a", None), ("b", 8.0)]  # old values don't return
    with pytest.raises(ValueError):
        m.upsert(make([("b", D(1), "x")], "vol string"))
    with pytest.raises(ValueError):
        m.read(["open"])
    with pytest.raises(ValueError):
        select_market(m.rows().drop("adj_factor"), ["close"], adjust="hfq")
    m.upsert(make([("a", D(2, y=2023), 1.0)], "close double").where("false"))
    assert rows(m.instruments(), "symbol", "start_date", "end_date") == [("a", D(2, y=2023), D(1)), ("b", D(1), D(1)), ("index_x", D(1), D(1))]
    assert rows(m.trade_dates(end="2023-12-31"), "trade_date") == [(D(2, y=2023),)]
    m.delete_symbols(["a"])
    assert rows(m.read(["close"]), "symbol", "close") == [("b", 6.0)]  # the year 2023 is gone as a whole
    m.delete_symbols(["b", "index_x"])
    assert m.read(include_indexes=True).count() == 0


def test_investable_by_hand(spark):
    days = [D(1, d) for d in range(1, 7)]
    panel = spark.createDataFrame([(c, d, t, None if (c, t) == ("a", 3) else 0.0 if (c, t) == ("a", 4) else 1.0) for c in "abcdef" for t, d in enumerate(days)], "code string, trade_date date, t int, open double")
    names = spark.createDataFrame([("b", "*ST x", D(1, 2), D(1, 3)), ("b", "fine", D(1, 4), None), ("c", "退", D(1, 5), None), ("d", None, None, None)], "code string, name string, start date, end date")
    basics = spark.createDataFrame([("d", D(1, 2), None), ("e", D(2), None), ("f", None, D(1, 4)), ("c", D(1, y=2020), None)], "code string, list_date date, delist_date date")
    got = {}
    for c, t in rows(universes.investable(panel, names, basics, 2), "code", "t"):
        got.setdefault(c, []).append(t)
    assert got == {"a": [0, 1, 2, 5], "b": [0, 3, 4, 5], "c": [2, 3], "d": [3, 4, 5], "f": [0, 1]}
    ahead = {c: [] for c in "abcdef"}
    for c, t in rows(universes.investable(panel, names, basics, 2, True), "code", "t"):
        ahead[c].append(t)
    assert ahead["a"] == [0, 1, 4] and ahead["d"] == [3, 4] and universes.investable(panel.where("false"), names, basics).count() == 0


@pytest.mark.parametrize("name", universe.QUERIES)
def test_queries_match_their_twins(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(universe.ORACLES[name]).df()
    assert len(want)
    pd.testing.assert_frame_equal(canon(universe.QUERIES[name](spark, SF).toPandas()), canon(want), check_dtype=False, rtol=1e-9, atol=2e-6)


def test_labels_equal_members_of_each_universe(spark):
    panel = spark.createDataFrame([(c, D(m)) for c in ("SH600000", "SZ300001", "XX1") for m in (1, 2, 3, 4)], "code string, trade_date date")
    held = spark.createDataFrame([("000300.SH", "SH600000", D(2)), ("000300.SH", "SZ300001", D(3, 15)), ("000905.SH", "XX1", D(1, y=2020)), ("other", "XX1", D(1))], "index_code string, code string, trade_date date")
    got = rows(universes.labelled(panel, held).selectExpr("explode(universes) as u", "code", "trade_date"), "u", "code", "trade_date")
    want = [(n, *r) for n in ("all", "hs300", "zz500", *universes.BOARDS) for r in rows(universes.members(panel, n, held), "code", "trade_date")]
    assert got == sorted(want, key=str)


def test_market_query_builds_the_panel_once(spark, monkeypatch):
    plans, upsert = [], MarketTable.upsert

    def seen(self, rows, order=None):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        upsert(self, rows, order)

    monkeypatch.setattr(MarketTable, "upsert", seen)
    assert universe.market_table(spark, SF).count() > 0
    assert len(plans) == 3 and not any("l_extendedprice" in p for p in plans)
