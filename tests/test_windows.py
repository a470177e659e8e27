"""Level kernels: one exchange a step and no stacked window sorts; the same values however the batches are cut, with gaps, repeats and symbols of unequal length."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelforge.operators import windows
from panelforge.plans.expression import Plan

WIDE = {"a": "rank(C)+rank(V)-rank(C*V)", "b": "ts_rank(C,7)+decay(V,5)", "c": "corr(C,V,6)", "d": "scale(C)+xmean(V)+rank_desc(V)", "e": "indneu(C,L2)"}


def frame(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, t, t, None if rng.random() < 0.1 else float(rng.integers(1, 9)), None if rng.random() < 0.1 else float(rng.integers(1, 9)), s % 2 if s else None) for s in range(7) for t in range(5 + 6 * s)]
    return spark.createDataFrame(rows, "symbol long, trade_date int, t int, close double, vol double, l2 long")


def test_a_step_is_one_exchange_and_holds_no_stack_of_sorts(spark):
    plan = Plan(WIDE).columns(frame(spark), ["symbol", "t"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # before: one sort of the whole rows for each ranked expression, all in one task
    assert plan.count("MapInArrow") == plan.count("Exchange") == 2


def test_ranks_and_groups_of_a_date(spark):
    df = frame(spark)
    p = df.toPandas()
    day = p.groupby("trade_date")
    r = lambda c: day[c].rank(pct=True)
    p["cv"] = p["close"] * p["vol"]
    day = p.groupby("trade_date")
    p["a"] = r("close") + r("vol") - r("cv")
    p["d"] = p["close"] / day["close"].transform("sum") + day["vol"].transform("mean") + 1 - day["vol"].rank(method="min", ascending=False) / day["vol"].transform("count")
    p["e"] = p["close"] - p.groupby(["trade_date", "l2"])["close"].transform("mean")
    got = Plan({k: WIDE[k] for k in "ade"}).columns(df).toPandas().sort_values(["symbol", "t"], ignore_index=True)
    pd.testing.assert_frame_equal(got[list("ade")], p.sort_values(["symbol", "t"], ignore_index=True)[list("ade")], check_dtype=False)


@pytest.mark.parametrize("op,want", [
    ("sum", lambda g: g.rolling(5, 1).sum()), ("sd", lambda g: g.rolling(5, 2).std()), ("ts_max", lambda g: g.rolling(5, 1).max()), ("rmedian", lambda g: g.rolling(5).median()),
    ("pvar", lambda g: g.rolling(5).var(ddof=0)), ("rskew", lambda g: g.rolling(5).skew()), ("rkurt", lambda g: g.rolling(5).kurt()), ("lead", lambda g: g.shift(-5)), ("ffill", lambda g: g.ffill()),
    ("wilder", lambda g: g.ewm(alpha=1 / 5, adjust=False, min_periods=5).mean()),
])
def test_symbol_windows_against_pandas(spark, op, want):
    df = frame(spark, 1)
    p = df.toPandas()
    got = Plan({"x": f"{op}(V,5)"}).columns(df).toPandas().sort_values(["symbol", "t"], ignore_index=True)["x"]
    exp = p.groupby("symbol", group_keys=False)["vol"].apply(want)
    if op in ("rskew", "rkurt"):  # a constant window has none
        flat = p.groupby("symbol", group_keys=False)["vol"].apply(lambda g: g.rolling(5).std() == 0)
        got, exp = got[~flat], exp[~flat]
    np.testing.assert_allclose(got.astype(float), exp.astype(float), atol=1e-9)


@pytest.mark.parametrize("key", ["symbol", "trade_date"])
def test_any_cut_of_the_batches(key):
    rng = np.random.default_rng(2)
    ids = np.repeat([1, 2, 5, 9], [3, 40, 1, 17])
    v = [[None if rng.random() < 0.2 else float(x) for x in row] for row in rng.integers(0, 5, (len(ids), 2))]
    t = np.concatenate([np.arange(k) for k in (3, 40, 1, 17)])
    batch = pa.RecordBatch.from_pydict({key: ids, "t": t, "_v": pa.array(v, pa.list_(pa.float64()))})
    nodes = [("avg", 4, ["x"]), ("ts_argmin", 4, ["x"])] if key == "symbol" else [("rank", None, ["x"]), ("xsum", None, ["y"])]
    run = windows.kernel(key, nodes, [key, "t"], ["x", "y"], 2)
    whole = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    for size in (1, 2, 7, 20):
        parts = [batch.slice(i, size) for i in range(0, len(ids), size)]
        assert pa.Table.from_batches(list(run(iter(parts)))).to_pylist() == whole


def test_a_turn_is_one_exchange_however_deep_it_nests(spark):
    df = frame(spark, 3)
    deep = {"x": "rank(decay(ts_rank(ema(V,3),4),3))", "y": "corr(rank(decay(ma(C,2),2)),V,4)"}
    plan = Plan(deep).columns(df, ["symbol", "t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3  # symbols, dates, symbols; before: one a depth, six
    whole = Plan(deep).columns(df).toPandas().sort_values(["symbol", "t"], ignore_index=True)
    step = df
    for name, text in (("v1", "ema(V,3)"), ("v2", "ts_rank(v1,4)"), ("v3", "decay(v2,3)"), ("c1", "ma(C,2)"), ("c2", "decay(c1,2)"), ("c3", "rank(c2)"), ("x", "rank(v3)"), ("y", "corr(c3,V,4)")):
        step = Plan({name: text}).columns(step)
    got = step.toPandas().sort_values(["symbol", "t"], ignore_index=True)
    assert whole["x"].notna().any() and whole["y"].notna().any()
    pd.testing.assert_frame_equal(whole[["x", "y"]], got[["x", "y"]])
