"""Any sequence of upserts is the table that knows the last word on every day."""

from datetime import date, timedelta

import numpy as np
import pytest

from panelforge.sources import dimensions

SCHEMA = "k string, v string, gone boolean, start date, end date, seq int"
DAY0 = date(2024, 1, 1)
D = lambda n: None if n is None else DAY0 + timedelta(days=int(n))


def apply(days, batch, horizon):
    """Day by day: of one batch the interval that starts last wins until the next one starts."""
    for k in {r[0] for r in batch if r[0]}:
        rows = sorted(((s, q, e, v, g) for kk, v, g, s, e, q in batch if kk == k and (e is None or e > s)))
        for s, q, e, v, g in rows:
            nxt = min((x[0] for x in rows if x[0] > s), default=horizon)
            if any(x[0] == s and x[1] > q for x in rows):
                continue
            for d in range(s, min(horizon if e is None else e, nxt)):
                days.pop((k, d), None)
                if not g:
                    days[k, d] = v


@pytest.mark.parametrize("seed", range(3))
def test_upserts_equal_the_daily_table(spark, tmp_path, seed):
    rng, horizon, days = np.random.default_rng(seed), 60, {}
    dim = dimensions.Dimension(spark, f"{tmp_path}/dim", ["k"], ["v"])
    assert dim.read() is None
    for _ in range(4):
        batch = []
        for q in range(12):
            s = int(rng.integers(0, 50))
            e = None if rng.random() < 0.2 else s + int(rng.integers(0, 15))
            batch.append((None if rng.random() < 0.05 else str(rng.choice(list("abc"))), None if rng.random() < 0.1 else str(rng.choice(list("xy"))), bool(rng.random() < 0.2), s, e, q))
        apply(days, batch, horizon)
        got = dim.upsert(spark.createDataFrame([(k, v, g, D(s), D(e), q) for k, v, g, s, e, q in batch], SCHEMA)).collect()
        seen = {}
        for r in got:
            a, z = (r.start - DAY0).days, horizon if r.end is None else min((r.end - DAY0).days, horizon)
            for d in range(a, z):
                assert (r.k, d) not in seen  # disjoint
                seen[r.k, d] = r.v
        assert seen == days
        ordered = sorted((r.k, r.start, r.end or date.max, r.v or "") for r in got)
        assert not any(x[0] == y[0] and x[2] == y[1] and x[3] == y[3] for x, y in zip(ordered, ordered[1:], strict=False))  # merged
    assert len(dim._versions()) == 4


def test_snapshot_touches_its_days_and_scope_only(spark):
    table = spark.createDataFrame([("a", "x", D(0), None), ("b", "x", D(0), D(40)), ("z", "x", D(0), None)], "k string, v string, start date, end date")
    members = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, v string")
    out = dimensions.snapshot(table, members, ["k"], ["v"], "k < 'm'", D(10), D(20))
    assert sorted((r.k, (r.start - DAY0).days, r.end and (r.end - DAY0).days) for r in out.collect()) == [("a", 0, None), ("b", 0, 10), ("b", 20, 40), ("c", 10, 20), ("z", 0, None)]
    assert sorted(r.k for r in dimensions.as_of(out, D(15)).collect()) == ["a", "c", "z"]
