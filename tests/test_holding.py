"""Holding rules on hand-worked sessions; a run continued from saved history is the run from the start, wherever it is cut."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from panelforge.operators import holding

CALM = dict(below=0, above=0, valid=3)


def play(rows, rules, n=None):
    state, out = {"target": [], "held": [], "since": None, "entry": None, "defence": None, "weak": None}, []
    for t, r in enumerate(rows):
        best = [{"symbol": s, "score": x} for s, x in r.get("best", [])]
        quotes = [{"symbol": s, "open": p, "close": p} for s, p in {0: 1.0, **r.get("px", {})}.items()]
        row = CALM | {"strategy": "x", "t": t, "defensive": 0, "strong": best, "weak_list": r.get("weak", best), "many": len(best), "weak_many": len(r.get("weak", best)), "quotes": quotes, "rebalance": r.get("go", True)}
        state = holding.step(state, row | {k: r[k] for k in ("below", "above") if k in r}, rules)
        out.append((state["reason"], state["target"]))
    return out, state


def test_least_holding_time():
    best = [[(1, 2.0), (2, 1.0)]] * 2 + [[(2, 3.0), (1, 1.0)]] * 6
    out, _ = play([{"best": b, "px": {1: 10.0, 2: 10.0}} for b in best], holding.Rules(least_hold=4))
    # bought by the target of session 0, held from 1 on; four sessions old at session 4
    assert out == [("best", [1])] + [("young", [1])] * 3 + [("best", [2])] + [("young", [2])] * 3


def test_a_holding_stays_while_it_scores_enough():
    rows = [{"best": b, "px": {1: 10.0, 2: 10.0}} for b in ([(1, 2.0), (2, 1.0)], [(2, 2.0), (1, 1.7)], [(2, 2.0), (1, 1.5)])]
    assert [t for _, t in play(rows, holding.Rules(least_hold=1))[0]] == [[1], [1], [2]]
    # three votes below: a weak market keeps nothing but the best
    assert [t for _, t in play([r | {"below": 3} for r in rows], holding.Rules(least_hold=1))[0]] == [[1], [2], [2]]


def test_stop_and_defence():
    px = [10.0, 10.0, 9.4, 12.0, 12.0, 12.0, 12.0]
    out, state = play([{"best": [(1, 2.0), (2, 1.9)], "px": {1: p, 2: 5.0}} for p in px], holding.Rules(least_hold=1, defence=3))
    assert [r for r, _ in out] == ["best", "best", "stop", "stop", "stop", "best", "best"]
    assert [t for _, t in out][2:6] == [[0], [0], [0], [1]] and state["defence"] is None


def test_few_or_weak_candidates_and_no_defensive_asset():
    px = {1: 1.0, 2: 1.0}
    rows = [{"best": [(1, 0.2)], "px": px}, {"best": [(1, 0.4)], "px": px}, {"best": [(1, 0.2), (2, 0.1)], "px": px}, {"best": [], "px": px}, {"best": [], "px": {0: None}}]
    assert play(rows, holding.Rules(least_hold=1))[0] == [("few", [0]), ("best", [1]), ("best", [1]), ("few", [0]), ("few", [])]


def test_between_rebalances_nothing_changes_but_the_stop():
    rows = [{"best": [(1, 2.0), (2, 1.0)], "px": {1: 10.0}}, {"best": [(2, 9.0), (3, 8.0)], "px": {1: 10.0}, "go": False}, {"best": [(2, 9.0), (3, 8.0)], "px": {1: 5.0}, "go": False}]
    assert play(rows, holding.Rules())[0] == [("best", [1]), ("between", [1]), ("stop", [0])]


def test_swaps():
    assert holding.choose([(5, 3.0), (6, 2.9), (7, 1.0)], [], 0.8, 2) == [5, 6]
    assert holding.choose([(5, 3.0), (6, 2.9), (7, 1.0)], [1, 2], 0.8, 2) == [5]  # nothing stays: one buy
    assert holding.choose([(5, 3.0), (6, 2.9), (7, 2.8)], [2, 7], 0.8, 2) == [7, 5]
    assert holding.choose([(5, 3.0), (6, 2.9), (7, 2.8)], [6, 7], 0.8, 2) == [6, 7]
    assert holding.choose([(5, 3.0)], [7], 0.8, 2) == [5] and holding.choose([], [7], 0.8, 2) == []


def test_weak_period_rests_while_the_defence_lasts():
    best = [(1, 2.0), (2, 1.0)]
    rows = [{"best": best, "px": {1: 10.0}, "below": 3}, {"best": best, "px": {1: 10.0}}, {"best": best, "px": {1: 5.0}, "above": 3}]
    assert play(rows, holding.Rules(least_hold=1))[1]["weak"] == 0
    assert play(rows[:2] + [rows[1] | {"above": 3}], holding.Rules(least_hold=1))[1]["weak"] is None


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(1)
    sessions, symbols = 30, 12
    px = 10 * np.exp(np.cumsum(rng.normal(0, 0.04, (sessions, symbols)), 0))
    rows = [(f"s{s % 2}", t, s, float(rng.random()), bool(rng.random() < 0.7), bool(rng.random() < 0.4), float(px[t, s]), float(px[t, s])) for t in range(sessions) for s in range(symbols)]
    d = spark.createDataFrame(rows, "strategy string, t int, symbol long, score double, strong boolean, weak boolean, open double, close double")
    votes = spark.createDataFrame([(t, int(rng.integers(0, 4)), int(rng.integers(0, 4)), 3) for t in range(sessions)], "t int, below int, above int, valid int")
    strategies = spark.createDataFrame([("s0", 0), ("s1", 1)], "strategy string, defensive long")
    return holding.packed(d, d, votes, strategies, F.col("t") % 2 == 0).cache()


@pytest.mark.parametrize("n", [1, 3])
def test_continued_runs_are_the_whole_run(spark, packed, n):
    rules = holding.Rules(n=n, least_hold=4)
    whole = holding.walk(packed, rules).cache()
    rows = sorted(map(str, whole.collect()))
    assert len(rows) == 60 and {r.reason for r in whole.select("reason").distinct().collect()} >= {"best", "between", "young", "stop"}
    for cut in (0, 13, 29):
        history = whole.where(F.col("t") <= cut)
        more = holding.walk(packed, rules, history)
        assert more.agg(F.min("t")).first()[0] in (cut + 1, None)
        assert sorted(map(str, history.unionByName(more).collect())) == rows
    # a strategy without history starts from its first session
    part = whole.where("strategy = 's0' and t <= 9")
    assert sorted(map(str, part.unionByName(holding.walk(packed, rules, part)).collect())) == rows
    last = holding.replay(whole).collect()
    for s in ("s0", "s1"):
        mine = [r for r in last if r.strategy == s]
        assert abs(sum(r.weight for r in mine) - 1) < 1e-12 and all(r.t == 29 for r in mine)


def test_sessions_of_the_panel_are_written_once(spark):
    from panelforge.plans.holding import sessions

    s = sessions(spark, "/root/testdata/sf0.001")
    assert s.count() > 0 and "l_extendedprice" not in s._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [1, 3])
def test_a_holding_stays_at_any_place(spark, n):
    """Listing the front and what can be held gives the walk over lists of every candidate."""
    rng = np.random.default_rng(7)
    sessions, symbols = 16, 60
    rows = [(t, s, 1.0 + float(rng.random()) * 0.2, bool(rng.random() < 0.9), bool(rng.random() < 0.9)) for t in range(sessions) for s in range(symbols)]
    d = spark.createDataFrame(rows, "t int, symbol long, score double, strong boolean, weak boolean").withColumn("strategy", F.lit("x")).withColumn("open", F.lit(10.0)).withColumn("close", F.lit(10.0))
    votes = spark.createDataFrame([(t, 3 * (t == 8), 0, 3) for t in range(sessions)], "t int, below int, above int, valid int")
    strategies = spark.createDataFrame([("x", 0)], "strategy string, defensive long")
    walk = lambda front, depth: sorted(map(str, holding.walk(holding.packed(d, d, votes, strategies, F.lit(True), front), holding.Rules(n=n, least_hold=1, depth=depth)).collect()))
    few = walk(6, None)
    assert few == walk(1000, None)
    # where only the ten best may stay, more is sold; before, the list ended there and nothing else was possible
    assert few != walk(10, 10) == walk(1000, 10)
