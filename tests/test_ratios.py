from datetime import date, timedelta

import numpy as np
import pytest

from panelforge.plans.ratios import expanding_ratio


def test_ratio_by_hand(spark):
    v = [None, 0.5, 0.5, 0.1, None, -0.3]
    rows = [(date(2024, 1, 1) + timedelta(days=i), f, x) for f, k in (("a", 1), ("b", -1)) for i, x in enumerate(None if x is None else k * x for x in v)]
    got = {(r.factor, (r.trade_date - date(2024, 1, 1)).days): r.ratio for r in expanding_ratio(spark.createDataFrame(rows, "trade_date date, factor string, x double"), "x").collect()}
    for i in range(6):
        seen = np.array([x for x in v[: i + 1] if x is not None])
        want = seen.mean() / seen.std(ddof=1) if len(set(seen)) > 1 else None
        for f, k in (("a", 1), ("b", -1)):
            assert got[f, i] == (None if want is None else pytest.approx(k * want, abs=1e-6))
