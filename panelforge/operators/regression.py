"""Cross-sectional regressions: one grouped kernel per date, linear algebra in NumPy.

A date's cross-section (some thousand rows of a few dozen regressors) is one group; the number of dates is the
parallelism, so nothing is gathered beyond one date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None):
    a = np.column_stack((np.ones(len(y)), x))
    s = np.sqrt(w)[:, None] if w is not None else 1.0
    return np.linalg.lstsq(a * s, y * (s[:, 0] if w is not None else 1.0), rcond=None)[0], a


def residuals(df: DataFrame, y: str, xs: list[str], keys: list[str], least: int = 20) -> DataFrame:
    """(keys, symbol, resid) of y on 1 + xs per group; rows with a missing part take no part; needs max(least, k + 5) rows."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", symbol {kinds['symbol']}, resid double"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y, *xs])
        if len(pdf) < max(least, len(xs) + 5):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*keys, "symbol", "resid"]})
        b, a = _fit(pdf[xs].to_numpy(float), pdf[y].to_numpy(float))
        return pdf[[*keys, "symbol"]].assign(resid=pdf[y].to_numpy(float) - a @ b)

    return df.select(*keys, "symbol", y, *xs).groupBy(*keys).applyInPandas(kernel, schema)


def coefficients(df: DataFrame, y: str, xs: list[str], keys: list[str], weight: str | None = None, least: int = 20) -> DataFrame:
    """(keys, name, beta) of the (weighted) regression of y on 1 + xs per group: exposures of a factor, or style returns."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", name string, beta double"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[keys].iloc[:1]
        pdf = pdf.dropna(subset=[y, *xs, *([weight] if weight else [])])
        if len(pdf) < max(least, len(xs) + 5):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*keys, "name", "beta"]})
        b, _ = _fit(pdf[xs].to_numpy(float), pdf[y].to_numpy(float), pdf[weight].to_numpy(float) if weight else None)
        return pd.concat([head] * len(b), ignore_index=True).assign(name=["const", *xs], beta=b)

    return df.select(*keys, y, *xs, *([weight] if weight else [])).groupBy(*keys).applyInPandas(kernel, schema)


def _moved(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of each value to all others, from the sorted order."""
    n, v = len(values), values[order]
    below = np.concatenate(([0.0], np.cumsum(v)[:-1]))
    out = np.empty(n)
    out[order] = v * np.arange(n) - below + (v.sum() - below - v) - v * (n - 1 - np.arange(n))
    return out


def _paired(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all ordered pairs of |xi - xj| |yi - yj|, for x in rising order.

    Level by level of a merge sort: between the halves of a block the sign of the first factor is known, and that of the second
    from running sums over the block in the order of y.
    """
    n, rank, total = len(x), np.empty(len(x), np.int64), 0.0
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    at, half = np.arange(n), 1
    while half < n:
        block, right = at // (2 * half), (at // half) % 2 == 1
        order = np.lexsort((rank, block))
        r = right[order]
        sums = np.cumsum(np.where(r, 0.0, [np.ones(n), x[order], y[order], x[order] * y[order]]), 1)
        ends = np.searchsorted(block[order], block[order], "right") - 1
        begins = np.searchsorted(block[order], block[order], "left")
        start = np.where(begins > 0, sums[:, begins - 1], 0.0)
        lower, whole = sums - start, sums[:, ends] - start
        c, sx, sy, sxy = 2 * lower - whole
        total += float((c * x[order] * y[order] - x[order] * sy - y[order] * sx + sxy)[r].sum())
        half *= 2
    return 2 * total


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Exact distance correlation (divisor n), O(n log^2 n) time and O(n) memory; NaN under ten values or without variance."""
    n = len(x)
    if n < 10:
        return float("nan")
    order = np.argsort(x, kind="stable")
    x, y = x[order] - x.mean(), y[order] - y.mean()
    a, b = _moved(x, np.arange(n)) / n, _moved(y, np.argsort(y, kind="stable")) / n
    product = lambda s, p, q: s / n**2 - 2 * (p * q).mean() + p.mean() * q.mean()
    squares = lambda v: 2 * n * (v * v).sum() - 2 * v.sum() ** 2
    den = np.sqrt(max(product(squares(x), a, a), 0) * max(product(squares(y), b, b), 0))
    return float(np.sqrt(max(product(_paired(x, y), a, b), 0) / den)) if den > 1e-15 else float("nan")


def nonlinear_ic(ev: DataFrame, sample: int | None = None) -> DataFrame:
    """(trade_date, factor, dcor): distance correlation of factor and label over all rows that have both; a ``sample`` of so many rows (by hash) only on demand."""
    rows = ev.select("trade_date", "factor", "symbol", "f", "r").dropna(subset=["f", "r"])
    if sample is not None:
        rank = F.row_number().over(Window.partitionBy("trade_date", "factor").orderBy(F.xxhash64("symbol", "trade_date"), "symbol"))
        rows = rows.withColumn("k", rank).where(F.col("k") <= sample).drop("k")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("symbol")
        return v[["trade_date", "factor"]].head(1).assign(dcor=distance_correlation(v["f"].to_numpy(float), v["r"].to_numpy(float)))

    out = rows.groupBy("trade_date", "factor").applyInPandas(kernel, "trade_date date, factor string, dcor double")
    return out.withColumn("dcor", F.nanvl("dcor", F.lit(None).cast("double")))


def ew_moments(df: DataFrame, y: str, x: str, window: int = 252, half_life: float = 63, least: int = 22) -> DataFrame:
    """(symbol, t, alpha, beta, ew_std): exponentially weighted regression of y on x over the last rows of each symbol."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        a, b = pdf[y].to_numpy(float), pdf[x].to_numpy(float)
        u, v = (np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(window - 1, np.nan), c)), window) for c in (a, b))
        ok = np.isfinite(u) & np.isfinite(v)
        w = ok * 0.5 ** (np.arange(window)[::-1] / half_life)
        w = w / np.maximum(w.sum(1), 1e-300)[:, None]
        mu, mv = ((w * np.where(ok, c, 0)).sum(1) for c in (u, v))
        du, dv = np.where(ok, u - mu[:, None], 0), np.where(ok, v - mv[:, None], 0)
        var, few = (w * dv * dv).sum(1), ok.sum(1) < least
        beta = np.where(few | (var <= 1e-20), np.nan, (w * du * dv).sum(1) / np.maximum(var, 1e-20))
        return pdf[["symbol", "t"]].assign(alpha=mu - beta * mv, beta=beta, ew_std=np.where(few, np.nan, np.sqrt((w * du * du).sum(1))))

    return df.select("symbol", "t", y, x).groupBy("symbol").applyInPandas(kernel, "symbol long, t int, alpha double, beta double, ew_std double")


def alarms(series: DataFrame, key: str = "series", hits: int = 3, within: int = 5, calm: int = 10, tail: float = 0.9) -> DataFrame:
    """(key, t, active): on after ``hits`` values at or above the tail in the last ``within``, off after ``calm`` quiet days."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        on, quiet, recent, out = False, 0, [], []
        for v in pdf["p"]:
            hit = v is not None and np.isfinite(v) and v >= tail
            recent = (recent + [hit])[-within:]
            quiet = 0 if hit else quiet + 1
            on = (sum(recent) >= hits) if not on else quiet < calm
            out.append(on)
        return pdf[[key, "t"]].assign(active=out)

    return series.select(key, "t", "p").groupBy(key).applyInPandas(kernel, f"{key} {dict(series.dtypes)[key]}, t int, active boolean")
