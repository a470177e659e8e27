"""The exposure engine against dense NumPy fits with one dummy column for each industry."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import exposure

NAMES = ["size", "beta", "value"]


def panel(days=5, symbols=60):
    rng = np.random.default_rng(11)
    out = []
    for d in range(days):
        for s in range(symbols):
            g = None if s == 7 else "solo" if s == 3 and d != 2 else f"i{s % 4}"
            if d == 4 and g == "i0":
                g = "i1"  # the reference industry has no rows on the last day
            size, beta, value = rng.normal(8, 2), rng.standard_t(3), None if s % 11 == 0 else rng.normal()
            out.append((d, s, "f", g, float(size), float(beta), None if value is None else float(value), float(rng.normal() + beta), None if s == 20 else float(rng.normal()), s != 50))
    return pd.DataFrame(out, columns=["day", "symbol", "factor", "g", *NAMES, "y", "r", "inside"])


SCHEMA = "day int, symbol long, factor string, g string, size double, beta double, value double, y double, r double, inside boolean"


@pytest.fixture(scope="module")
def data(spark):
    p = panel()
    return p, spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in p.itertuples(index=False)], SCHEMA).repartition(3).cache()


def dense_fit(p, y, xs, weight=None, scaled=False, blocks=None):
    """Residuals by symbol and coefficients of one day, dummies written out; the first industry present is the reference."""
    v = p.dropna(subset=[y, *xs, *(["g"] if blocks else []), *([weight] if weight else [])])
    yy = v[y].to_numpy(float)
    yy = (yy - yy.mean()) / yy.std() if scaled else yy
    present = [b for b in blocks or [] if (v.g == b).any()]
    cols = [np.ones(len(v)), *(v[x].to_numpy(float) for x in xs), *((v.g == b).to_numpy(float) for b in present[1:])]
    a, w = np.column_stack(cols), np.sqrt(v[weight].to_numpy(float)) if weight else np.ones(len(v))
    b = np.linalg.lstsq(a * w[:, None], yy * w, rcond=None)[0]
    names = ["intercept", *xs, *(f"ind_{c}" for c in present[1:])]
    return dict(zip(v.symbol, yy - a @ b, strict=True)), dict(zip(names, b, strict=True))


@pytest.mark.parametrize("weight,scaled", [(None, True), ("size", False)])
def test_block_regression_is_the_dense_one(data, weight, scaled):
    p, df = data
    blocks = exposure.industries(df, "g")
    assert blocks[0] in ("i1", "i0") and set(blocks) == {"i0", "i1", "i2", "i3", "solo"}
    fit = exposure.Regression(df, "y", NAMES, ["day"], "g", blocks, weight=weight, scaled=scaled)
    resid, beta = fit.residuals().toPandas(), fit.coefficients().toPandas()
    for d, part in p.groupby("day"):
        want, coef = dense_fit(part, "y", NAMES, weight, scaled, blocks)
        got = dict(zip(*resid[resid.day == d][["symbol", "resid"]].to_numpy().T, strict=True))
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)
        have = dict(zip(*beta[beta.day == d][["name", "beta"]].to_numpy().T, strict=True))
        assert all(abs(have[k] - coef[k]) < 1e-9 for k in coef)
        assert all(have[k] == 0 for k in have.keys() - coef.keys())
    solo = resid[(resid.symbol == 3) & (resid.day != 2)].resid
    assert np.allclose(solo, 0, atol=1e-12)  # an industry of one has no residual


def test_too_few_rows_and_collinear_columns(data):
    p, df = data
    assert exposure.Regression(df.where("symbol < 15"), "y", NAMES, ["day"]).residuals().count() == 0
    twin = df.withColumn("again", df["size"] * 2)
    a = exposure.Regression(df, "y", NAMES, ["day"]).residuals().toPandas().sort_values(["day", "symbol"])
    b = exposure.Regression(twin, "y", [*NAMES, "again"], ["day"]).residuals().toPandas().sort_values(["day", "symbol"])
    assert np.allclose(a.resid, b.resid, atol=1e-8)


def test_standardise(data):
    p, df = data
    got = exposure.standardise(df, {n: n for n in NAMES}, "size", "inside", "day").toPandas().sort_values(["day", "symbol"])
    raw = exposure.standardise(df.drop("size", "beta", "value").join(df.selectExpr("day", "symbol", "size a", "beta b", "value c"), ["day", "symbol"]), dict(zip(NAMES, "abc", strict=True)), "size", "inside", "day")
    z = raw.toPandas().sort_values(["day", "symbol"])
    assert len(got) == len(z) == len(p)
    for d, part in p.groupby("day"):
        part = part.sort_values("symbol")
        m = part.inside.to_numpy()
        w = np.where(m, np.exp(np.clip(part["size"].to_numpy(float), -40, 40)), np.nan)

        def standard(x, w=w):
            ok = np.isfinite(x)
            return (x - (x[ok] * w[ok]).sum() / w[ok].sum()) / x[ok].std()

        want = {}
        for n in NAMES:
            x = np.where(m, part[n].to_numpy(float), np.nan)
            mu, sd = np.nanmean(x), np.nanstd(x)
            want[n] = standard(np.clip(x, mu - 2.5 * sd, mu + 2.5 * sd))
        s, ok = want["size"], m
        ww = w[ok] / w[ok].sum()
        xc, yc = s[ok] - (ww * s[ok]).sum(), s[ok] ** 3 - (ww * s[ok] ** 3).sum()
        nl = np.full(len(s), np.nan)
        nl[ok] = yc - (ww * xc * yc).sum() / (ww * xc * xc).sum() * xc
        want["nlsize"] = standard(nl)
        here = z[z.day == d]
        for n in want:
            assert np.allclose(here[n].to_numpy(float), want[n], atol=1e-9, equal_nan=True), n


def test_attribution_adds_up(data):
    p, df = data
    blocks = exposure.industries(df, "g")
    daily = exposure.attribution(df, "y", "r", NAMES, "g", blocks, keys=("day", "factor"))
    d = exposure.attribution_over_time(daily, 3, keys=("day", "factor")).toPandas()
    for day, part in d.groupby("day"):
        v = dict(zip(part.name, part.attr, strict=True))
        legs = [v[n] for n in v if n in NAMES or n.startswith("ind_")]
        assert abs(sum(legs) - v["explained"]) < 1e-12 and abs(v["explained"] + v["residual"] - v["factor_return"]) < 1e-12
        assert abs(sum(v[n] for n in v if n.startswith("ind_")) - v["attr_industry"]) < 1e-12
        one = p[p.day == day]
        _, b = dense_fit(one, "y", NAMES, scaled=True, blocks=blocks)
        _, f = dense_fit(one, "r", NAMES, blocks=blocks)
        assert all(abs(v[n] - b[n] * f[n]) < 1e-9 for n in NAMES)
    s = exposure.attribution_summary(daily).toPandas().set_index("name")
    assert abs(s.cum_attr["residual"] / s.cum_attr["factor_return"] - s.residual_share["residual"]) < 1e-12
    assert np.isnan(d[d.day == 1].ma_f).all() and d[(d.day == 3) & (d.name == "size")].ma_f.notna().all()


def test_neutral_score(data):
    p, df = data
    out = exposure.neutralised(df, "y", NAMES, ["day"], "inside").toPandas()
    for d, part in p.groupby("day"):
        got = out[out.day == d].set_index("symbol").y
        want, _ = dense_fit(part[part.inside], "y", NAMES)
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        lost = part[part.inside & part.value.isna()].symbol
        assert got[lost].isna().all() and got[50] == part.set_index("symbol").y[50]
    few = exposure.neutralised(df, "y", NAMES, ["day"], "inside", least=200).toPandas()
    whole = p[p.value.notna()].sort_values(["day", "symbol"])
    kept = few[few.value.notna()].sort_values(["day", "symbol"])
    assert np.allclose(whole.y, kept.y)


def test_the_standardised_frame_is_written_once(spark):
    from panelforge.plans.exposure import standardised

    ev = standardised(spark, "/root/testdata/sf0.001")
    assert ev.count() > 0 and "l_extendedprice" not in ev._jdf.queryExecution().optimizedPlan().toString()
