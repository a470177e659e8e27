"""Data-parallel training against one NumPy loop on whole data, partitions that don't matter, factor choice and swaps."""

from itertools import combinations

import numpy as np
import pytest


from panelforge.operators import neural, ranker
from test_ranker import COLS, market

NET = neural.Network(hidden=(5, 3), steps=12, select=2, least_ic=10)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(20, 3)), rng.normal(size=20), neural.start(3, NET, 7)
    g, _ = neural.gradient(x, y, w, NET.hidden)
    for i in range(0, len(w), 3):
        e = np.zeros(len(w))
        e[i] = 1e-6
        assert abs((neural.gradient(x, y, w + e, NET.hidden)[1] - neural.gradient(x, y, w - e, NET.hidden)[1]) / 2e-6 - g[i]) < 1e-5


def test_training_is_one_loop_whatever_the_partitions(spark):
    rng = np.random.default_rng(1)
    data = {m: rng.normal(size=(60, 3)) for m in (1, 2)}
    label = {m: np.tanh(v[:, 0] - v[:, 2]) for m, v in data.items()}
    rows = [(m, 3, [float(v) for v in data[m][a : a + 10].ravel()], [float(v) for v in label[m][a : a + 10]]) for m in data for a in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "model int, width int, x array<double>, y array<double>")
    chosen = {1: [(0, 1), (2, -1)], 2: [(2, 1), (1, 1)]}
    one, many = (neural.train(df.repartition(k), chosen, NET) for k in (1, 8))
    for m, c in chosen.items():
        x, w = data[m][:, [k for k, _ in c]] * [s for _, s in c], neural.start(2, NET, m)
        a, b = np.zeros_like(w), np.zeros_like(w)
        before = neural.gradient(x, label[m], w, NET.hidden)[1]
        for step in range(1, NET.steps + 1):
            g = (neural.gradient(x, label[m], w, NET.hidden)[0] + NET.decay * w) / 60
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            w = w - NET.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        assert np.abs(one[m] - many[m]).max() < 1e-6 and np.abs(one[m] - w).max() < 1e-6
        assert neural.gradient(x, label[m], w, NET.hidden)[1] < before


def test_factor_choice():
    r = ranker.Rolling(lookback=3, horizon=2)
    factors = {"a": 1, "b": 1, "c": -1}
    ics = {(d, "a"): 0.1 for d in range(20)} | {(d, "b"): -0.5 if d <= 8 else 0.9 for d in range(20)} | {(d, "c"): None for d in range(20)}
    assert neural.choose(ics, 10, r, neural.Network(select=2), factors) == [(1, -1), (0, 1)]  # what is realised after session 8 is not known on 10
    assert neural.choose(ics, 10, r, neural.Network(select=0), factors) == [(0, 1), (1, 1), (2, -1)]
    assert neural.choose({}, 10, r, neural.Network(select=2), factors) == []


def test_rank_correlations(spark):
    rng = np.random.default_rng(2)
    v = [(t, float(rng.integers(0, 4)), None if i == 3 else float(rng.normal())) for t in range(3) for i in range(20 if t else 5)]
    got = {r.t: r.ic for r in neural.rank_correlations(spark.createDataFrame(v, "t int, f double, y double"), ["f"], 10).collect()}
    import pandas as pd

    for t, p in pd.DataFrame(v, columns=["t", "f", "y"]).dropna().groupby("t"):
        assert got[t] is None if t == 0 else abs(got[t] - p.f.rank().corr(p.y.rank())) < 1e-12


def test_rolling_network_looks_at_realised_dates_only(spark):
    r = ranker.Rolling(lookback=20, horizon=1, refit=8, least_rows=200, least_groups=10, blend=0.8, smooth=0.5)
    whole = neural.rolling_scores(spark.createDataFrame(market(), COLS), {"a": 1, "b": -1}, list(range(2, 60, 8)), r, NET).toPandas().set_index(["t", "symbol"]).sort_index()
    cut = neural.rolling_scores(spark.createDataFrame(market(cut=42), COLS), {"a": 1, "b": -1}, list(range(2, 46, 8)), r, NET).toPandas().set_index(["t", "symbol"]).sort_index()
    assert np.allclose(cut.score.to_numpy(float), whole.loc[:42].score.to_numpy(float), equal_nan=True, atol=1e-6)
    assert whole.loc[26:].model.notna().sum() > 150 and whole.loc[:10].model.isna().all() and whole.loc[2].score.notna().sum() == 39


@pytest.mark.parametrize("bound", [0.0, 0.2, 5.0])
def test_bounded_picks(spark, bound):
    rng = np.random.default_rng(6)
    rows = [(t, s, float(rng.normal()), float(rng.normal(1.0 if t else -0.5)) if s else None) for t in range(6) for s in range(11)]
    out = ranker.bounded_picks(spark.createDataFrame(rows, "t int, symbol long, score double, size double"), 4, bound).toPandas()
    for t, part in out.groupby("t"):
        pool = {s: (x, z) for d, s, x, z in rows if d == t and z is not None}
        held = set(part.symbol)
        mean = lambda h, pool=pool: abs(np.mean([pool[s][1] for s in h]))
        assert len(held) == 4 and np.allclose(part.weight, 0.25) and part.feasible.all() == (mean(held) <= bound)
        near = [held - {i} | {j} for i in held for j in pool.keys() - held]
        if not part.feasible.all():
            assert min(map(mean, near)) >= mean(held) - 1e-9
        else:
            total = sum(pool[s][0] for s in held)
            assert not [h for h in near if mean(h) <= bound and sum(pool[s][0] for s in h) > total + 1e-9]
            best = max((sum(pool[s][0] for s in h) for h in combinations(pool, 4) if mean(h) <= bound))
            assert bound < 5 or abs(total - best) < 1e-12
    assert bound == 0 or out.feasible.mean() > 0.6


def test_icir_weights(spark):
    """Constant positive correlation, no positive one, and too little history."""
    rows = []
    for t in range(40):
        for s in range(20):
            rows.append((t, s, 100.0 * 1.01 ** (t * (s + 1)), True, float(s), -float(s)))
    df = spark.createDataFrame(rows, COLS)
    weights = lambda signs: {(r.t, r.factor): r.weight for r in neural.icir_scores(df, signs, [5, 30], 20, 2, 10, 8)[1].collect()}
    assert weights({"a": 1, "b": 1}) == {(5, "a"): 0.5, (5, "b"): 0.5, (30, "a"): 1.0, (30, "b"): 0.0}
    assert weights({"a": -1, "b": 1}) == {(t, f): 0.5 for t in (5, 30) for f in "ab"}
    assert weights({"a": 1, "b": -1})[30, "b"] == 0.5
    scores = {(r.t, r.symbol): r.score for r in neural.icir_scores(df, {"a": 1, "b": 1}, [30], 20, 2, 10, 8)[0].collect()}
    z = (np.arange(20) - 9.5) / np.arange(20).std()
    assert np.allclose([scores[30, s] for s in range(20)], z)
