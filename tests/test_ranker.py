"""Boosted ranking trees against a NumPy version on whole data, fallbacks, and no look ahead."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from panelforge.operators import boosting, ranker

S = boosting.Settings(trees=4, rate=0.3, depth=2, least=15, bins=16, top=10)
FEATURES = ["a", "b"]


def learn_table(days=14, symbols=40, models=(1, 2)):
    rng = np.random.default_rng(2)
    out = []
    for m in models:
        for t in range(days):
            for s in range(symbols):
                a, b = rng.normal(), float(rng.integers(0, 5))
                y = np.sin(2 * a) * m + (b == 3) + rng.normal() * 0.3
                out.append((m, t, s, float(a) if s else None, b, float(y)))
    return out


def brute_gradients(score, grade, top):
    """Pair by pair."""
    n = len(score)
    order = sorted(range(n), key=lambda i: (-score[i], i))
    place = {r: k for k, r in enumerate(order)}
    gain, disc = [2.0**g - 1 for g in grade], [1 / np.log2(k + 2) for k in range(n)]
    best = sum(g * d for g, d in zip(sorted(gain, reverse=True)[:top], disc, strict=False))
    g, h, total = np.zeros(n), np.zeros(n), 0.0
    for i in range(n):
        for j in range(n):
            if grade[i] > grade[j] and min(place[i], place[j]) < top:
                d = (gain[i] - gain[j]) * abs(disc[place[i]] - disc[place[j]]) / best
                if max(score) != min(score):
                    d /= 0.01 + abs(score[i] - score[j])
                p = 1 / (1 + np.exp(score[i] - score[j]))
                g[i], g[j], total = g[i] - p * d, g[j] + p * d, total + 2 * p * d
                h[i], h[j] = h[i] + p * (1 - p) * d, h[j] + p * (1 - p) * d
    k = np.log2(1 + total) / total if total else 1
    return g * k, h * k


def test_gradients():
    rng = np.random.default_rng(0)
    for score in (np.zeros(12), np.round(rng.normal(size=12), 1)):
        grade = rng.integers(0, 5, 12)
        assert all(np.allclose(x, y) for x, y in zip(boosting.gradients(score, grade, 4), brute_gradients(score, grade, 4), strict=True))
    assert not boosting.gradients(np.zeros(5), np.zeros(5, int), 3)[0].any()


def brute_forest(days, s):
    """days: [(bins, grade)] of one model -> scores of every day after all trees, by trees grown on the whole table."""
    score = [np.zeros(len(g)) for _, g in days]
    x = np.concatenate([b for b, _ in days])
    for _ in range(s.trees):
        g, h = (np.concatenate(v) for v in zip(*(brute_gradients(sc, gr, s.top) for sc, (_, gr) in zip(score, days, strict=True)), strict=True))

        def grow(rows, depth):
            gt, ht = g[rows].sum(), h[rows].sum()
            best = (0, None)
            for f in range(x.shape[1]):
                for c in range(s.bins):
                    left = rows[x[rows, f] <= c]
                    right = rows[x[rows, f] > c]
                    if min(len(left), len(right)) >= s.least:
                        gain = round(g[left].sum() ** 2 / (h[left].sum() + s.ridge) + g[right].sum() ** 2 / (h[right].sum() + s.ridge) - gt**2 / (ht + s.ridge), 12)
                        if gain > best[0]:
                            best = (gain, (left, right))
            if depth == 0 or best[1] is None:
                return [(rows, -s.rate * gt / (ht + s.ridge))]
            return grow(best[1][0], depth - 1) + grow(best[1][1], depth - 1)

        flat = np.concatenate(score)
        for rows, v in grow(np.arange(len(x)), s.depth):
            flat[rows] += v
        score = np.split(flat, np.cumsum([len(q) for q in score])[:-1])
    return score


def test_forest_is_the_whole_table_one(spark):
    df = spark.createDataFrame(learn_table(), "model int, t int, symbol long, a double, b double, y double").repartition(5)
    rows = boosting.learn_rows(df, FEATURES, "y", S).cache()
    cuts = boosting.edges(rows, 2, S)
    packed = boosting.pack(rows, cuts).cache()
    forests = boosting.fit(packed, cuts, S)
    for m in (1, 2):
        days = sorted((r.t, np.frombuffer(b"".join(r.bins), np.uint8).reshape(len(r.grade), -1), np.array(r.grade)) for r in packed.where(f"model = {m}").collect())
        assert len(days) == 14 and all(len(g) == 39 and list(np.bincount(g)) == [8, 8, 8, 8, 7] for _, _, g in days)
        want = brute_forest([d[1:] for d in days], S)
        for (_, bins, _), w in zip(days, want, strict=True):
            assert np.allclose(boosting.scores(bins, forests[m]), w, atol=1e-9)
    gained = lambda score, g: ((2.0 ** g[np.argsort(-score, kind="stable")] - 1)[:10] / np.log2(np.arange(2, 12))).sum()
    assert sum(gained(boosting.scores(b, forests[2]), g) for _, b, g in days) > 1.3 * sum(gained(np.zeros(len(g)), g) for _, b, g in days)
    out = boosting.predict(df.where("t = 0"), FEATURES, forests).collect()
    assert sum(r.tree is None for r in out) == 2 and len({round(r.tree, 9) for r in out if r.tree is not None}) > 4
    outer = boosting.learn_rows(df, FEATURES, "y", boosting.Settings(group=20)).groupBy("model", "t").agg(F.count("*").alias("n"), F.sum(F.when(F.col("grade").isin(0, 4), 1).otherwise(0)).alias("o")).collect()
    assert all(r.n == 20 and r.o >= 15 for r in outer)


def market(symbols=40, sessions=60, cut=None):
    rng = np.random.default_rng(4)
    rows, px = [], np.full(symbols, 100.0)
    f = rng.normal(size=(sessions, symbols))
    for t in range(sessions):
        px = px * np.exp(0.02 * np.sin(2 * f[t - 1]) * (t > 0) + 0.01 * rng.normal(size=symbols))
        for s in range(symbols):
            close = None if (t, s) == (5, 5) else float(px[s])
            rows.append((t, s, close if cut is None or t <= cut else 1.0 + s, s != 39, float(f[t, s]) if cut is None or t <= cut else 0.0, float(s % 7)))
    return rows


COLS = "t int, symbol long, close double, in_universe boolean, a double, b double"
R = ranker.Rolling(lookback=20, horizon=1, refit=8, least_rows=200, least_groups=10, boost=S)


@pytest.fixture(scope="module")
def full(spark):
    return ranker.rolling_scores(spark.createDataFrame(market(), COLS), {"a": 1, "b": -1}, list(range(2, 60, 4)), R).toPandas().set_index(["t", "symbol"]).sort_index()


def test_rolling_scores(full):
    used = full.dropna(subset="model").groupby("t").model.agg(["min", "max"])
    assert (used["min"] == used["max"]).all() and used.index.min() == 22  # the first date with lookback + horizon sessions
    assert used["min"].to_dict() == {22: 22, 26: 22, 30: 30, 34: 30, 38: 38, 42: 38, 46: 46, 50: 46, 54: 54, 58: 54}
    assert full.loc[2].model.isna().all() and full.score.notna().sum() == 15 * 39 and full.loc[(2, 39)].isna().all()


def test_early_scores_are_equal_weights(full):
    p = {(t, s): (a, b) for t, s, _, ok, a, b in market() if ok}
    z = lambda v: (v - v.mean()) / v.std()
    prev = None
    for t in (2, 6, 10):
        a, b = (np.array([p[t, s][k] for s in range(39)]) for k in (0, 1))
        now = (z(a) + z(-b)) / 2
        prev = now if prev is None else 0.6 * now + 0.4 * prev
        assert np.allclose(full.loc[t].score.to_numpy(float)[:39], prev)


def test_the_future_changes_nothing(spark, full):
    cut = ranker.rolling_scores(spark.createDataFrame(market(cut=42), COLS), {"a": 1, "b": -1}, list(range(2, 46, 4)), R).toPandas().set_index(["t", "symbol"]).sort_index()
    assert np.allclose(cut.score.to_numpy(float), full.loc[:42].score.to_numpy(float), equal_nan=True, atol=1e-9)


def test_trees_beat_equal_weights_where_the_link_is_bent(spark, full):
    rows = {(t, s): c for t, s, c, *_ in market()}
    late = full.loc[30:54].reset_index().dropna(subset="score")
    late["y"] = [rows[t + 1, s] / rows[t, s] - 1 for t, s in zip(late.t, late.symbol, strict=True)]
    ic = lambda c: late.groupby("t").apply(lambda d: d[c].rank().corr(d.y.rank()), include_groups=False).mean()
    assert ic("score") > 0.3


def test_too_little_history(spark):
    out = ranker.rolling_scores(spark.createDataFrame(market(sessions=12), COLS), {"a": 1}, [4, 8], R).toPandas()
    assert out.model.isna().all() and out.score.notna().sum() == 2 * 39
    top = ranker.picks(spark.createDataFrame(out[["t", "symbol", "score"]].dropna()), 5).toPandas()
    assert len(top) == 10 and np.allclose(top.weight, 0.2)


def test_neutral_factors_are_written_once(spark):
    from panelforge.plans import learned

    z = learned.neutral(learned.panel(spark, "/root/testdata/sf0.001"))
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    assert z.count() > 0 and "l_extendedprice" not in plan and "Join" not in plan


def test_a_model_learns_from_every_row_of_a_date(spark):
    df = spark.createDataFrame(learn_table(days=1, symbols=901, models=(1,)), "model int, t int, symbol long, a double, b double, y double")
    rows = boosting.learn_rows(df, FEATURES, "y", boosting.Settings())
    assert rows.count() == 900  # one has no feature; before: 512
    assert [r["count"] for r in rows.groupBy("grade").count().orderBy("grade").collect()] == [180] * 5


def test_gradients_of_a_large_date_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    small = rng.normal(size=90), rng.integers(0, 5, 90)
    assert all(np.allclose(x, y) for x, y in zip(boosting.gradients(*small, 50), brute_gradients(*small, 50), strict=True))
    score, grade = rng.normal(size=40_000), rng.integers(0, 5, 40_000)
    tracemalloc.start()
    g, _ = boosting.gradients(score, grade, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(g.sum()) < 1e-9 and peak < 50 * 40_000 * 8 * 4, peak  # before: a dozen arrays of head * rows numbers
