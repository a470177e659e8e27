"""The attribution tree: root equals the compounded active return, parents equal their children, own effects as defined."""

import numpy as np
import pandas as pd

from panelforge.operators import attribution

LEVELS = ["a", "b", "s"]


def table(days=6):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(days):
        wp, wb = rng.dirichlet(np.ones(12)), rng.dirichlet(np.ones(12))
        wb[:3], wp[3:5] = 0, 0  # a group that the benchmark doesn't hold, assets that the portfolio doesn't
        for s in range(12):
            rows.append((t, s // 6, s // 3, s, float(wp[s] / wp.sum()), None if s == 1 else float(wb[s] / wb.sum()), float(rng.normal(0, 0.05))))
    return rows + [(0, 0, 0, 99, 0.1, 0.1, None), (0, None, 0, 98, 0.1, 0.1, 0.5)]


def test_tree(spark):
    rows = table()
    out = attribution.tree(spark.createDataFrame(rows, "t int, a int, b int, s int, wp double, wb double, r double").repartition(3), LEVELS).toPandas()
    assert (out.residual.abs() < 1e-10).all() and out.groupby("level").size().to_dict() == {0: 1, 1: 2, 2: 4, 3: 12}
    d = pd.DataFrame(rows, columns=["t", *LEVELS, "wp", "wb", "r"]).dropna(subset=["r", "a"]).fillna({"wb": 0.0})
    p, b = ((1 + (d[w] * d.r).groupby(d.t).sum()).prod() for w in ("wp", "wb"))
    assert abs(out[out.level == 0].subtotal.iloc[0] - (p - b)) < 1e-12
    assert abs(out[out.level == 1].subtotal.sum() - (p - b)) < 1e-12 and abs(out[out.level == 3].effect.sum() + out[out.level == 2].effect.sum() + out[out.level == 1].effect.sum() - (p - b)) < 1e-12


def test_one_day_by_hand(spark):
    rows = [(0, 1, 1, 1, 0.6, 0.25, 0.10), (0, 1, 1, 2, 0.0, 0.25, 0.02), (0, 2, 2, 3, 0.4, 0.5, -0.04)]
    out = attribution.daily_effects(spark.createDataFrame(rows, "t int, a int, b int, s int, wp double, wb double, r double"), LEVELS).toPandas()
    e = {(r.level, r.a, r.s if r.level == 3 else 0): r.effect for r in out.itertuples() if r.level != 2}
    rb = 0.25 * 0.10 + 0.25 * 0.02 + 0.5 * -0.04
    assert abs(e[1, 1, 0] - (0.6 - 0.5) * (0.06 - rb)) < 1e-15
    assert abs(e[3, 1, 1] - (0.6 - 0.3) * (0.10 - 0.06)) < 1e-15 and abs(e[3, 1, 2] - (0.0 - 0.3) * (0.02 - 0.06)) < 1e-15 and abs(e[3, 2, 3]) < 1e-15
    assert abs(out.effect.sum() - (0.06 - 0.016 - rb)) < 1e-15
