"""A refresh equals the run from the start, and reads what the changes reach; configurations and registry by hand-worked cases."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelforge.plans import incremental
from panelforge.plans.expression import Plan
from panelforge.plans.reach import WHOLE, Reach, Refresh, reach, signatures
from panelforge.sources import registry

from test_queries import SF, canon

SCHEMA = "symbol long, trade_date date, t int, close double, vol double, ret double, l2 long"
DATES = [date(2024, 1, 1) + timedelta(days=i) for i in range(60)]
LOCAL = {"a": "sum(C,5)", "b": "d(V,3)", "c": "slope(ma(C,4),6)", "m": "ts_argmax(V,4)"}
CROSS = {"r": "rank(lag(C,2))", "n": "corr(rank(C),rank(V),4)"}
LONG = {"e": "ema(C,3)", "f": "ffill(V)", "l": "lead(C,2)-C", "g": "indneu(C,L2)"}


def panel(spark, cells, dates=DATES):
    rows = [(s, d, t, *[None if v is None else float(v) for v in cells[s, d]], s % 2) for s in sorted({k[0] for k in cells}) for t, d in enumerate(dates)]
    return spark.createDataFrame(rows, SCHEMA)


def cells(seed=0, symbols=6):
    rng = np.random.default_rng(seed)
    return {(s, d): [None, None, None] if rng.random() < 0.1 else list(rng.integers(1, 50, 3)) for s in range(symbols) for d in DATES}


def rows(df):
    return sorted(tuple(r) for r in df.select("factor", "symbol", "trade_date", "value").collect())


def refresh(spark, formulas, old, new, known=None):
    plan = Plan(formulas)
    job = Refresh(plan, old, new, known)
    got, want = rows(job.run(plan.long(old))), rows(plan.long(new))
    read = job.inputs().count()
    job.close()
    assert got == want
    return read


def test_reach_adds_up_through_the_plan():
    r = reach(Plan({"x": "ts_max(rank(d(C,5)),3)", "y": "ema(V,4)+lag(H,2)", "z": "lead(O,2)-ma(L,4)", "k": "slope(V,3)"}))
    assert r["x"]["close"] == Reach(7, 0, True)
    assert r["y"] == {"vol": Reach(WHOLE), "high": Reach(2), "close": Reach()}
    assert r["z"] == {"open": Reach(0, 2), "low": Reach(3), "close": Reach()}
    assert r["k"] == {"vol": Reach(2), "t": Reach(2), "close": Reach()}


def test_local_change_reads_one_symbol_and_few_rows(spark):
    old = cells()
    new = {k: list(v) for k, v in old.items()}
    new[2, DATES[30]] = [999, 998, 1]
    assert refresh(spark, LOCAL, panel(spark, old), panel(spark, new)) <= 8 + 8 + 1  # of 360: slope of a mean looks 8 back, and 8 outputs follow
    cross = refresh(spark, CROSS, panel(spark, old), panel(spark, new))
    assert cross <= 6 * 9
    refresh(spark, LOCAL | CROSS | LONG, panel(spark, old), panel(spark, new))


@pytest.mark.parametrize("seed", range(2))
def test_any_changes(spark, seed):
    rng, old = np.random.default_rng(10 + seed), cells(seed)
    new = {k: list(v) for k, v in old.items()}
    for _ in range(5):
        k = (int(rng.integers(0, 6)), DATES[int(rng.integers(0, 60))])
        new[k] = [None, None, None] if rng.random() < 0.3 else list(rng.integers(1, 50, 3))
    for k in list(old):
        if k[0] == 5:
            del old[k]  # a symbol that is new
        if k[0] == 4:
            del new[k]  # and one that went
    refresh(spark, LOCAL | CROSS | LONG, panel(spark, old), panel(spark, new))


def test_calendar_grows_at_the_end_in_the_middle_and_shrinks(spark):
    full = cells(3)
    without = lambda gone: panel(spark, {k: v for k, v in full.items() if k[1] not in gone}, [d for d in DATES if d not in gone])
    everything = LOCAL | CROSS | LONG
    assert refresh(spark, LOCAL | CROSS, without(DATES[57:]), without([])) <= 6 * (3 + 9)
    refresh(spark, everything, without([DATES[20]]), without([]))
    refresh(spark, everything, without([]), without([DATES[20], DATES[59]]))


def test_nothing_changed_reads_nothing_and_new_formulas_are_computed(spark):
    p = panel(spark, cells(4))
    assert refresh(spark, LOCAL, p, p) == 0
    plan, before = Plan(LOCAL | {"b": "d(C,3)"}), Plan({**LOCAL, "gone": "C"})
    job = Refresh(plan, p, p, signatures(before))
    assert rows(job.run(before.long(p))) == rows(plan.long(p))
    assert signatures(Plan({"a": "q+1"}, {"q": "ma(C,2)"})) == signatures(Plan({"a": "ma(C,2) + 1.0"}))
    empty = p.where("false")
    job = Refresh(plan, p, empty)
    assert job.run(plan.long(p)).count() == 0
    assert rows(Refresh(plan, empty, p).run(plan.long(empty))) == rows(plan.long(p))


@pytest.mark.parametrize("name", incremental.QUERIES)
def test_queries_match_their_twins(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "part", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(incremental.ORACLES[name]).df()
    assert len(want)
    pd.testing.assert_frame_equal(canon(incremental.QUERIES[name](spark, SF).toPandas()), canon(want), check_dtype=False, rtol=1e-9, atol=2e-6)


def config(spark, *rows):
    return spark.createDataFrame([(n, k, f, m, s) for n, k, f, m, s in rows], registry.SCHEMA)


def test_config_diff(spark):
    old = config(spark, ("bars", "panel", ["open", "close", "ts_code"], None, {}), ("idx", "panel", ["close"], ["i1"], {}), ("names", "side", ["n"], None, {"src": "a", "Token": "x"}), ("old", "panel", ["z"], None, None))
    new = config(spark, ("bars", "panel", ["close", "vol", "trade_date"], None, {}), ("idx", "panel", ["close"], ["i1", "i2"], {}), ("names", "side", ["n"], None, {"src": "a", "token": "y"}), ("fresh", None, ["q", None], None, None), (None, "panel", None, None, None))
    got = lambda f: {(r.name, r.action): (r.fields, r.members) for r in f.collect()}
    assert got(registry.diff(old, new)) == {
        ("bars", "install"): (["vol"], []), ("bars", "drop_fields"): (["open"], []), ("idx", "install"): (["close"], ["i2"]), ("fresh", "install"): (["q"], []), ("old", "remove"): (["z"], []),
    }
    present = spark.createDataFrame([("idx", "i2")], "name string, member string")
    assert got(registry.diff(new, new, present)) == {("idx", "install"): (["close"], ["i1"])}
    assert got(registry.diff(old, new, empty=True)) == {("names", "install"): (["n"], [])}
    other = config(spark, ("names", "side", ["n"], None, {"src": "b"}))
    assert got(registry.diff(old.where("name = 'names'"), other)) == {("names", "install"): (["n"], [])}


def test_registry_versions(spark, tmp_path):
    r = registry.Registry(spark, f"{tmp_path}/registry")
    assert r.read().count() == 0
    r.register(config(spark, ("bars", "panel", ["open"], None, {"token": "secret", "src": "v"})))
    r.register(config(spark, ("bars", "panel", ["vol"], None, {"src": "w"}), ("names", "side", ["n"], None, None)), "update")
    got = {x.name: x for x in r.read().collect()}
    assert got["bars"].fields == ["open", "vol"] and got["bars"].settings == {"src": "w"} and got["names"].action == "update"
    r.drop_fields("bars", ["open"])
    r.unregister(["names"])
    assert [(x.name, x.fields) for x in r.read().collect()] == [("bars", ["vol"])]
    r.replace(config(spark, ("only", "panel", [], None, None)))
    assert [x.name for x in r.read().collect()] == ["only"]
    r.clear()
    assert r.read().count() == 0
