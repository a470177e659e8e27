"""Rotation over traded funds: trend scores, filters, weak-market periods, clone removal.

Every function takes bars (symbol, trade_date, t, close, ...) and its thresholds as parameters.  Scores and filters are window
expressions on the symbol, so one shuffle; the weak period is one row a session; clones are decided in one group a date, whose
size is the pool times the window.
"""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-18  # a variation up to this is none


def dot(weights: list[float], values: Column) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def last_logs(bars: DataFrame, rows: int) -> DataFrame:
    """``bars`` with a positive close, and ``v``: its log and the ``rows`` before; null while there are fewer."""
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(-rows, 0)
    v = F.collect_list(F.log("close")).over(w)
    return bars.where("close > 0").withColumn("v", v).withColumn("v", F.when(F.size("v") == rows + 1, F.col("v")))


def trend(v: Column, rows: int, year: int) -> Column:
    """(score, annual, r2) of a weighted line through ``v``; weights run from 1 to 2, squared for the fit, plain for R2.

    score = annual * r2 with annual = exp(year * slope) - 1; a flat series has r2 0.
    """
    n = rows + 1
    x, w = range(n), [1 + k / rows for k in range(n)]
    total = sum(a * a for a in w)
    centre = sum(a * a * k for a, k in zip(w, x, strict=True)) / total
    spread = sum(a * a * (k - centre) ** 2 for a, k in zip(w, x, strict=True))
    rise = [a * a * (k - centre) / spread for a, k in zip(w, x, strict=True)]
    level = [a * a / total - r * centre for a, r in zip(w, rise, strict=True)]

    def variation(base) -> Column:
        return F.aggregate(F.transform(v, lambda y, i: (1 + i / rows) * (y - base(i)) * (y - base(i))), F.lit(0.0), lambda s, e: s + e)

    line = F.struct(dot(rise, v).alias("slope"), dot(level, v).alias("level"), dot([1 / n] * n, v).alias("mean"))

    def fit(p: Column) -> Column:
        left, all_ = variation(lambda i: p["level"] + p["slope"] * i), variation(lambda i: p["mean"])
        annual = F.exp(p["slope"] * year) - 1
        r2 = F.when(all_ > FLAT, 1 - left / F.nullif(all_, F.lit(0.0))).otherwise(0.0)
        return F.struct((annual * r2).alias("score"), annual.alias("annual"), r2.alias("r2"))

    return F.when(v.isNotNull(), F.element_at(F.transform(F.array(line), fit), 1))


def log_momentum(bars: DataFrame, rows: int = 25, year: int = 250) -> DataFrame:
    """(symbol, trade_date, t, score, annual, r2); null until ``rows`` + 1 valid closes."""
    return last_logs(bars, rows).select("symbol", "trade_date", "t", trend(F.col("v"), rows, year).alias("m")).select("symbol", "trade_date", "t", "m.*")


def smoothing(n: int, sigma: float) -> list[list[float]]:
    """The Gaussian filter of ``n`` values, reflected at both ends, as a matrix (n above 3 sigma)."""
    radius = max(1, ceil(3 * sigma))
    if n <= radius:
        raise ValueError(f"{n} values are too few to reflect {radius}")
    kernel = [exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    out = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for d, k in zip(range(-radius, radius + 1), kernel, strict=True):
            j = abs(i + d)
            out[i][j if j < n else 2 * (n - 1) - j] += k / sum(kernel)
    return out


def adaptive_momentum(bars: DataFrame, rows: int = 25, year: int = 250, choppy: float = 0.35, rough: float = 0.18, sigma: float = 1.5, gain: float = 8.0, most: float = 5.0) -> DataFrame:
    """(symbol, trade_date, t, score, kind): the line's score where its R2 reaches ``choppy``, else that of the smoothed line, and under ``rough`` with its curvature besides."""
    d = last_logs(bars, rows).where("v is not null")
    matrix = F.array(*(F.array(*map(F.lit, r)) for r in smoothing(rows + 1, sigma)))
    d = d.withColumn("g", F.transform(matrix, lambda r: F.aggregate(F.zip_with(r, F.col("v"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    d = d.select("symbol", "trade_date", "t", "g", trend(F.col("v"), rows, year).alias("m"), trend(F.col("g"), rows, year).alias("s"))
    curve = F.element_at("g", -3) - 2 * F.element_at("g", -2) + F.element_at("g", -1)
    kind = F.when(F.col("m.r2") >= choppy, "linear").when(F.col("m.r2") >= rough, "gauss").otherwise("laplace")
    score = F.when(kind == "linear", F.col("m.score")).when(kind == "gauss", F.col("s.score")).otherwise(F.least(F.lit(most), F.col("s.score") + gain * curve))
    return d.select("symbol", "trade_date", "t", score.alias("score"), kind.alias("kind"))


def filters(bars: DataFrame, ma: int = 10, over: float = 1.0, volume: int = 5, floor: float = 0.97) -> DataFrame:
    """(symbol, t, above, volume_ratio, worst): over valid closes, close above its mean, volume against the mean before (null unless all positive), worst of the last three steps."""
    own = Window.partitionBy("symbol").orderBy("t")
    last, past = own.rowsBetween(1 - ma, 0), own.rowsBetween(-volume, -1)
    step = F.col("close") / F.nullif(F.lag("close").over(own), F.lit(0.0))
    d = bars.where("close > 0").withColumn("step", step)
    full = (F.count("vol").over(past) == volume) & (F.min("vol").over(past) > 0) & (F.col("vol") >= 0)
    return d.select(
        "symbol", "t",
        F.when(F.count("close").over(last) == ma, F.col("close") > F.avg("close").over(last) * over).otherwise(False).alias("above"),
        F.when(full, F.col("vol") / F.nullif(F.avg("vol").over(past), F.lit(0.0))).alias("volume_ratio"),
        F.when(F.lag("close", 3).over(own).isNotNull(), F.min("step").over(own.rowsBetween(-2, 0)) >= floor).otherwise(True).alias("holds"),
    )


def votes(indices: DataFrame, ma: int = 10) -> DataFrame:
    """indices(name, trade_date, t, px) -> one row a session: how many stand below and above their mean, and how many have one."""
    last = Window.partitionBy("name").orderBy("t").rowsBetween(1 - ma, 0)
    d = indices.where("px is not null").withColumn("m", F.when(F.count("px").over(last) == ma, F.avg("px").over(last)))
    return d.groupBy("trade_date", "t").agg(F.sum((F.col("px") < F.col("m")).cast("int")).alias("below"), F.sum((F.col("px") > F.col("m")).cast("int")).alias("above"), F.count("m").alias("valid"))


def weak_periods(votes: DataFrame, need: int = 3, longest: int = 20) -> DataFrame:
    """(trade_date, t, weak, start): a period starts, or starts anew, with enough votes below; it ends with enough above or after ``longest`` sessions.

    Of fewer indices than ``need`` all must agree, two at least.  One row a session, so one small group.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        start, out = None, []
        for t, below, above, valid in zip(pdf["t"], pdf["below"].fillna(0), pdf["above"].fillna(0), pdf["valid"], strict=True):
            enough = need if valid < 2 else min(need, valid)
            if start is not None and (t - start + 1 >= longest or above >= enough):
                start = None
            elif below >= enough:
                start = t
            out.append(start)
        start = pd.array(out, dtype="Int32")
        return pdf[["trade_date", "t"]].assign(weak=~start.isna(), start=start)

    day = votes.schema["trade_date"].dataType.simpleString()
    return votes.withColumn("market", F.lit("all")).groupBy("market").applyInPandas(kernel, f"trade_date {day}, t int, weak boolean, start int")


def targets(scored: DataFrame, passed: DataFrame, periods: DataFrame, n: int, low: float = 0.0, high: float = 5.0, r2: float = 0.4, crowd: float = 1.8) -> DataFrame:
    """(trade_date, symbol, k): the ``n`` best scores that pass; R2 counts in strong markets, the mean in weak ones; ties to the smaller symbol."""
    d = scored.join(passed, ["symbol", "t"]).join(F.broadcast(periods.select("t", "weak")), "t")  # one row a session
    ok = F.col("score").between(low, high) & F.when(F.col("weak"), F.col("above")).otherwise(F.col("r2") > r2) & (F.col("volume_ratio") < crowd) & F.col("holds")
    return best(d.where(ok), n)


def best(scored: DataFrame, n: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "symbol"))
    return scored.withColumn("k", k).where(F.col("k") <= n).select("trade_date", "symbol", "k")


def ranked(scored: DataFrame, n: int, breadth: float = 0.4) -> DataFrame:
    """(trade_date, symbol, k): the ``n`` best rising symbols; none on a date where fewer than ``n`` of them have an R2 over ``breadth``."""
    up = scored.where("annual > 0 and r2 > 0 and score is not null")
    wide = up.groupBy("t").agg(F.sum((F.col("r2") > breadth).cast("int")).alias("wide")).where(F.col("wide") >= n).select("t")
    return best(up.join(F.broadcast(wide), "t"), n)  # one row a session


def leg(spread: DataFrame, window: int = 5) -> DataFrame:
    """spread(trade_date, spread) -> perf, leg: momentum while the sum over ``window`` sessions is positive, the other leg while negative, else the one before (at first momentum).

    One row a session; the window over all of them is as small.
    """
    every = Window.orderBy("trade_date")
    last = every.rowsBetween(1 - window, 0)
    d = spread.withColumn("perf", F.when(F.count("spread").over(last) == window, F.sum("spread").over(last)))
    sign = F.when(F.col("perf") > 0, "momentum").when(F.col("perf") < 0, "a088")
    return d.select("trade_date", "perf", F.coalesce(F.last(sign, ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0)), F.lit("momentum")).alias("leg"))


def unlike(pool: DataFrame, returns: DataFrame, days: int = 60, least: int = 40, cut: float = 0.9) -> DataFrame:
    """pool(trade_date, t, symbol, money), returns(symbol, t, ret) -> (trade_date, symbol) without clones: by falling money (ties: smaller symbol)
    a symbol stays unless its correlation over the last ``days`` sessions with one that stays is ``cut`` or more; pairs with fewer common values than ``least`` are no clones.
    """
    rows = pool.select("trade_date", "symbol", "money", F.explode(F.sequence(F.col("t") - days + 1, F.col("t"))).alias("t")).join(returns.select("symbol", "t", "ret"), ["symbol", "t"], "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="symbol", columns="t", values="ret", dropna=False)
        money = pdf.groupby("symbol")["money"].first()
        order = sorted(money.index, key=lambda s: (-money[s] if money[s] == money[s] else np.inf, s))
        x = wide.reindex(order).to_numpy(float)
        have = np.isfinite(x)
        n = have.sum(1, keepdims=True)
        x = np.where(have, x - np.divide(np.where(have, x, 0).sum(1, keepdims=True), n, where=n > 0, out=np.zeros(n.shape)), 0)
        size = np.sqrt((x**2).sum(1))
        scale = np.outer(size, size)
        corr = np.divide(x @ x.T, scale, where=scale > 1e-12, out=np.zeros(scale.shape))
        clone = (corr >= cut) & (have.astype(float) @ have.T >= least)
        stays = np.zeros(len(order), bool)
        for j in range(len(order)):
            stays[j] = not (clone[j] & stays).any()
        return pd.DataFrame({"trade_date": pdf["trade_date"].iloc[0], "symbol": np.array(order)[stays]})

    day, symbol = (pool.schema[c].dataType.simpleString() for c in ("trade_date", "symbol"))
    return rows.groupBy("trade_date").applyInPandas(kernel, f"trade_date {day}, symbol {symbol}")
