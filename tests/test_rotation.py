"""Rotation operators on values worked out by hand or with NumPy."""

import numpy as np
import pytest

from panelforge.operators import rotation


def bars(spark, closes, symbol=1):
    return spark.createDataFrame([(symbol, t, t, c, 1.0) for t, c in enumerate(closes)], "symbol long, trade_date int, t int, close double, vol double")


def test_log_momentum_of_a_line_and_of_noise(spark):
    noisy = np.exp(np.random.default_rng(0).normal(0, 0.02, 12)).tolist()
    line = [float(np.exp(0.01 * t)) for t in range(12)]
    got = {(r.symbol, r.t): r for r in rotation.log_momentum(bars(spark, line).union(bars(spark, noisy, 2)).union(bars(spark, [5.0] * 12, 3)), 8, 20).collect()}
    assert got[1, 7].score is None and got[1, 8].annual == pytest.approx(np.expm1(0.2)) and got[1, 11].r2 == pytest.approx(1)
    y, w = np.log(noisy[3:]), np.linspace(1, 2, 9)
    slope, level = np.polyfit(np.arange(9), y, 1, w=w)
    r2 = 1 - (w * (y - level - slope * np.arange(9)) ** 2).sum() / (w * (y - y.mean()) ** 2).sum()
    assert got[2, 11].r2 == pytest.approx(r2) and got[2, 11].score == pytest.approx(np.expm1(20 * slope) * r2)
    assert got[3, 11].score == 0 and got[3, 11].r2 == 0


def test_smoothing_reflects_and_keeps_constants():
    m = np.array(rotation.smoothing(26, 1.5))
    k = np.exp(-0.5 * (np.arange(-5, 6) / 1.5) ** 2)
    y = np.random.default_rng(1).normal(size=26)
    assert m.sum(1) == pytest.approx(np.ones(26))
    assert m @ y == pytest.approx(np.convolve(np.pad(y, 5, mode="reflect"), k / k.sum(), mode="valid"))
    with pytest.raises(ValueError):
        rotation.smoothing(5, 1.5)


def test_adaptive_momentum_names_its_form(spark):
    line = [float(np.exp(0.01 * t)) for t in range(12)]
    saw = [1.0 + 0.1 * (t % 2) for t in range(12)]
    got = {r.symbol: r.kind for r in rotation.adaptive_momentum(bars(spark, line).union(bars(spark, saw, 2)), 8).where("t = 11").collect()}
    assert got == {1: "linear", 2: "laplace"}


def test_weak_period_starts_restarts_and_ends(spark):
    #       below, above: start, again, quiet, above ends it, start, then four sessions are the longest
    votes = [(3, 0), (3, 0), (1, 1), (0, 3), (0, 3), (4, 0), (0, 0), (0, 0), (2, 0), (0, 0)]
    df = spark.createDataFrame([(t, t, b, a, 4) for t, (b, a) in enumerate(votes)], "trade_date int, t int, below long, above long, valid long")
    got = [r.start for r in rotation.weak_periods(df, longest=4).orderBy("t").collect()]
    assert got == [0, 1, 1, None, None, 5, 5, 5, None, None]
    # of two indices both decide, of four three must
    for valid, start in ((2, 0), (4, None)):
        few = spark.createDataFrame([(0, 0, 2, 0, valid)], df.schema)
        assert [r.start for r in rotation.weak_periods(few).collect()] == [start]
    assert rotation.weak_periods(df.limit(0)).count() == 0


def test_filters(spark):
    got = {r.t: r for r in rotation.filters(bars(spark, [1.0, 1.0, 1.0, 1.0, 0.9, None, 0.9, 0.9, 0.95]), ma=3, volume=2).collect()}
    assert got[1].volume_ratio is None and got[2].volume_ratio == 1 and not got[1].above and got[2].holds and 5 not in got
    assert not got[4].holds and not got[7].holds and got[8].holds and got[8].above


def test_unlike_keeps_the_most_traded_of_clones(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=30), rng.normal(size=30)
    series = {1: a, 2: a * 2 + 1e-6 * b, 3: b, 4: -a, 5: a}
    money = {1: 5.0, 2: 9.0, 3: 1.0, 4: None, 5: 9.0}
    rets = spark.createDataFrame([(s, t, float(v)) for s, x in series.items() for t, v in enumerate(x) if not (s == 5 and t == int(np.argmin(abs(a))))], "symbol long, t int, ret double")
    pool = spark.createDataFrame([(29, 29, s, m) for s, m in money.items()], "trade_date int, t int, symbol long, money double")
    got = {r.symbol for r in rotation.unlike(pool, rets, 30, 30).collect()}
    assert got == {2, 3, 4, 5}  # five has too few common values to be a clone
    assert {r.symbol for r in rotation.unlike(pool, rets, 30, 20).collect()} == {2, 3, 4}
    assert rotation.unlike(pool.limit(0), rets).count() == 0


def test_breadth_gate_and_leg(spark):
    rows = [(0, s, 0, 1.0 - s / 10, 1.0, 0.5 if s < 2 else 0.1) for s in range(4)] + [(1, s, 1, 0.5, 1.0, 0.5) for s in range(3)]
    got = rotation.ranked(spark.createDataFrame(rows, "trade_date int, symbol long, t int, score double, annual double, r2 double"), 3, 0.4).collect()
    assert sorted((r.trade_date, r.symbol, r.k) for r in got) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    spread = spark.createDataFrame([(t, v) for t, v in enumerate([-1.0, -1.0, 3.0, -2.0, None, 1.0, -1.0])], "trade_date int, spread double")
    assert [r.leg for r in rotation.leg(spread, 2).orderBy("trade_date").collect()] == ["momentum", "a088", "momentum", "momentum", "momentum", "momentum", "momentum"]
