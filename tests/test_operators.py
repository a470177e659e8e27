import numpy as np
import pandas as pd
import pytest

from panelforge.operators import allocators, backtest, regression
from panelforge.plans.expression import Plan
from panelforge.sources.store import FactorStore
from panelforge.sources.vendor import Slice, plan, register


def panel(spark, rows=60, symbols=3, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        c = 10.0
        for t in range(rows):
            c *= float(np.exp(rng.normal(0, 0.02)))
            gone = (t + s) % 17 == 5
            out.append((s, (pd.Timestamp("2020-01-01") + pd.Timedelta(days=t)).to_pydatetime(), t, None if gone else c * 0.99, None if gone else c * 1.01, None if gone else c * 0.98, None if gone else c, None if gone else float(rng.integers(1, 100)), None if gone else c * 10, None if gone else c, None if gone else float(rng.normal()), None if gone else c * 100, 0, 0, 0))
    cols = "symbol long, trade_date timestamp, t int, open double, high double, low double, close double, vol double, amount double, vwap double, ret double, mv double, l1 int, l2 int, l3 int"
    return spark.createDataFrame(out, cols)


def test_ema_is_pandas(spark):
    df = panel(spark)
    got = Plan({"e": "ema(C,5)"}).columns(df).select("symbol", "t", "close", "e").toPandas().sort_values(["symbol", "t"])
    for _, g in got.groupby("symbol"):
        want = g["close"].astype(float).ewm(span=5, adjust=False, min_periods=5).mean()
        np.testing.assert_allclose(g["e"].astype(float), want, rtol=1e-12)


def test_ts_rank_and_decay(spark):
    df = panel(spark)
    got = Plan({"r": "ts_rank(C,7)", "k": "decay(V,4)"}).columns(df).select("symbol", "t", "close", "vol", "r", "k").toPandas().sort_values(["symbol", "t"])
    for _, g in got.groupby("symbol"):
        want = g["close"].astype(float).rolling(7, min_periods=1).rank(method="average")
        np.testing.assert_allclose(g["r"].astype(float), want, rtol=1e-12)


def test_future_does_not_change_history(spark):
    df = panel(spark)
    formulas = {"a": "rank(ts_argmax(C,5))", "b": "corr(C,V,6)", "c": "ema(C,5)"}
    full = Plan(formulas).columns(df).where("t < 40").select("symbol", "t", *formulas).toPandas().sort_values(["symbol", "t"], ignore_index=True)
    cut = Plan(formulas).columns(df.where("t < 40")).select("symbol", "t", *formulas).toPandas().sort_values(["symbol", "t"], ignore_index=True)
    pd.testing.assert_frame_equal(full, cut)


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"d": np.repeat([1, 2], 50), "symbol": np.tile(np.arange(50), 2), "x": rng.normal(size=100), "z": rng.normal(size=100), "y": rng.normal(size=100)})
    got = regression.residuals(spark.createDataFrame(pdf), "y", ["x", "z"], ["d"]).toPandas().merge(pdf, on=["d", "symbol"])
    for _, g in got.groupby("d"):
        assert abs(g["resid"].sum()) < 1e-9 and abs(g["resid"] @ g["x"]) < 1e-9 and abs(g["resid"] @ g["z"]) < 1e-9


def test_alarm_machine(spark):
    p = [0, 0.95, 0.95, 0, 0.95] + [0.0] * 12
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(p)], "series string, t int, p double")
    got = [r.active for r in regression.alarms(df).orderBy("t").collect()]
    assert got[:4] == [False] * 4 and got[4] and got[13] and not got[14]


@pytest.mark.parametrize("name", sorted(allocators.ALLOCATORS))
def test_weights_are_feasible(name):
    r = np.random.default_rng(3).normal(0.001, 0.02, (60, 6)) * np.arange(1, 7)
    w = allocators.ALLOCATORS[name](r, 0.4)
    assert abs(w.sum() - 1) < 1e-8 and (w >= -1e-12).all() and (w <= 0.4 + 1e-9).all()


def test_min_vol_beats_equal():
    r = np.random.default_rng(3).normal(0, 0.02, (200, 5)) * np.arange(1, 6)
    s = np.cov(r, rowvar=False)
    w, e = allocators.min_vol(r), allocators.equal(r)
    assert w @ s @ w < e @ s @ e
    inv = np.linalg.solve(s, np.ones(5))
    np.testing.assert_allclose(w, inv / inv.sum(), atol=1e-4)


def test_efficient_targets():
    r = np.random.default_rng(4).normal(0.001, 0.02, (120, 5)) + np.arange(5) * 0.0005
    m, s = r.mean(0), np.cov(r, rowvar=False)
    target = (m.min() + m.max()) / 2
    assert m @ allocators.efficient_return(r, target) >= target - 1e-9
    w = allocators.efficient_risk(r, 0.015)
    assert np.sqrt(w @ s @ w) <= 0.015 + 1e-6


def test_allocation_covers_every_rebalance_date(spark):
    from panelforge.plans import kernels
    from panelforge.sources.panel import dense

    sf = "/root/testdata/sf0.001"
    want = {(r.trade_date, r.symbol) for r in dense(spark, sf).where("t >= 24 and mv is not null and (month(trade_date) % 3 = 0 or t % 5 = 0)").collect()}
    got = kernels.allocation(spark, sf).toPandas()
    assert set(got["allocator"]) == set(allocators.ALLOCATORS) and {"efficient_return", "efficient_risk"} <= set(allocators.ALLOCATORS)
    for _, g in got.groupby("allocator"):
        assert len(g) == len(want) and set(zip(g["trade_date"], g["symbol"], strict=True)) == want
    np.testing.assert_allclose(got.groupby(["trade_date", "allocator"])["weight"].sum(), 1, atol=1e-8)


def test_fill_rules():
    nan = np.nan
    shares, cash, trades = backtest.fill(np.array([1000.0, 500.0, 0.0]), 0.0, np.array([0.0, 0.5, 0.5]), np.array([10.0, 20.0, nan]), np.array([nan] * 3), np.array([nan] * 3))
    assert shares[0] == 0 and shares[2] == 0 and cash >= 0 and trades[0][1] == -1000
    shares, _, _ = backtest.fill(np.array([1000.0]), 0.0, np.array([0.0]), np.array([9.0]), np.array([11.0]), np.array([9.0]))
    assert shares[0] == 1000  # at the lower limit nothing is sold
    shares, _, _ = backtest.fill(np.array([0.0]), 1e5, np.array([1.0]), np.array([11.0]), np.array([11.0]), np.array([9.0]))
    assert shares[0] == 0  # at the upper limit nothing is bought


def test_fill_of_very_large_orders_ends():
    none = np.array([np.nan] * 3)
    for cash in (1e6, 1e12, 3.7e19, 1e26):  # one lot less changes nothing in the digits of the larger ones
        shares, left, trades = backtest.fill(np.zeros(3), cash, np.full(3, 1 / 3), np.array([7.3, 11.1, 1234.5]), none, none, 1)
        assert len(trades) == 3 and left >= 0 and left < cash * 1e-2
    for n, price, cash in ((500.0, 7.3, 2000.0), (400.0, 10.0, 3.0), (1000.0, 2.5, 2400.0)):
        step = n
        while step > 0 and step * price + backtest.fee(step * price, False) > cash:
            step -= 100
        assert backtest.affordable(n, price, cash, 100) == step


def test_store_round_trip(spark, tmp_path):
    s = FactorStore(spark, f"file://{tmp_path}/store")
    cols = "trade_date date, symbol long, value double, factor string"
    day = lambda d: pd.Timestamp(f"2020-01-{d:02d}").date()
    s.write(spark.createDataFrame([(day(1), 1, 1.0, "a"), (day(2), 1, 2.0, "a"), (day(1), 1, 5.0, "b")], cols))
    s.write(spark.createDataFrame([(day(2), 1, 9.0, "a"), (day(3), 1, 3.0, "a")], cols))
    assert [r.value for r in s.read(["a"]).orderBy("trade_date").collect()] == [1.0, 9.0, 3.0]
    s.write(spark.createDataFrame([(day(3), 1, 7.0, "a"), (day(4), 1, 4.0, "a")], cols), "append")
    assert [r.value for r in s.read(["a"]).orderBy("trade_date").collect()] == [1.0, 9.0, 3.0, 4.0]
    assert {r.factor: r.last_date for r in s.watermark().collect()} == {"a": day(4), "b": day(1)}
    s.purge(["b"])
    assert s.read().select("factor").distinct().count() == 1
    with pytest.raises(ValueError):
        s.write(spark.createDataFrame([(day(1), 1, None, "c")], cols))


def test_vendor_source(spark):
    register(spark, "demo_vendor", lambda part, offset, limit: [(part, i) for i in range(7)][offset : offset + limit], "d string, i int", ["x", "y"], page=3)
    assert spark.read.format("demo_vendor").load().groupBy("d").count().count() == 2
    assert spark.read.format("demo_vendor").load().count() == 14
    assert plan(Slice.BY_PANEL, [], list(range(5)), 2) == [(0, 1), (2, 3), (4,)]


def test_store_trim(spark, tmp_path):
    s = FactorStore(spark, f"file://{tmp_path}/store")
    day = lambda m, d: pd.Timestamp(f"2020-{m:02d}-{d:02d}").date()
    rows = [(day(1, 1), 1, 1.0, "a"), (day(2, 1), 1, 2.0, "a"), (day(2, 1), 1, 5.0, "b"), (day(1, 2), 1, 7.0, "c")]
    s.write(spark.createDataFrame(rows, "trade_date date, symbol long, value double, factor string"))
    s.trim_from(day(1, 15))
    assert sorted((r.factor, r.value) for r in s.read().collect()) == [("a", 1.0), ("c", 7.0)]
    s.trim_from(day(1, 1))
    assert s._all() is None or s._all().count() == 0


def test_distance_correlation_is_the_quadratic_form():
    rng = np.random.default_rng(9)
    for n in (10, 11, 64, 257):
        for x, y in ((rng.normal(size=n), rng.normal(size=n)), (rng.integers(0, 3, n).astype(float), rng.integers(0, 4, n) * 1e3 + 1e6), (np.arange(n) - n / 2, (np.arange(n) - n / 2) ** 2)):
            a, b = (np.abs(v[:, None] - v[None, :]) for v in (x, y))
            a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
            want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
            assert abs(regression.distance_correlation(x, y) - want) < 1e-7
    assert np.isnan(regression.distance_correlation(np.ones(20), np.arange(20.0))) and np.isnan(regression.distance_correlation(np.arange(9.0), np.arange(9.0)))
    x = rng.normal(size=50_000)  # all pairs would be 20 GB
    assert regression.distance_correlation(x, x * x) > 0.3
