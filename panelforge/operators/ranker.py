"""Rolling ranked-tree strategy: factors combined by boosted trees that are refitted on realised dates only.

On a rebalance date ``t`` a model may know the dates up to ``t - horizon``, whose returns over ``horizon`` sessions are realised.  It learns
from every ``stride``-th of the last ``lookback`` of them, is kept for ``refit`` sessions, and where it can't be fitted the last one goes on;
before the first one the score is the mean of the factors' z-scores.  All models are fitted together (see ``boosting``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import boosting
from panelforge.sources.stage import discard, staged


@dataclass(frozen=True)
class Rolling:
    lookback: int = 252
    horizon: int = 20
    refit: int = 20
    least_rows: int = 400
    least_groups: int = 12
    most_groups: int = 80  # the latest realised dates a model learns from
    blend: float = 0.45
    smooth: float = 0.4
    boost: boosting.Settings = field(default_factory=boosting.Settings)

    step: int | None = None  # sessions between the dates it learns from; by default a quarter of the horizon

    @property
    def stride(self) -> int:
        return self.step or max(1, self.horizon // 4)


def zscore(c: Column, day: str = "t") -> Column:
    """Equal-weight z-score over a date's values; without variance 0."""
    w = Window.partitionBy(day)
    sd = F.stddev_pop(c).over(w)
    return F.when(c.isNotNull(), F.when((F.count(c).over(w) < 2) | (sd < 1e-12), 0.0).otherwise((c - F.avg(c).over(w)) / sd))


def prepared(panel: DataFrame, factors: dict[str, int], horizon: int, mask: str) -> DataFrame:
    """(t, symbol, inside, one z a factor, equal, y): z-scores inside the mask, their mean, the realised return over ``horizon`` sessions of a dense panel."""
    ahead = F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("t"))
    y = F.when((F.col("close") > 0) & (ahead > 0), ahead / F.col("close") - 1)
    p = panel.select("t", "symbol", F.coalesce(F.col(mask), F.lit(False)).alias("inside"), y.alias("y"), *(F.when(F.col(mask), F.col(f) * sign).alias(f) for f, sign in factors.items()))
    p = p.select("t", "symbol", "inside", "y", *(zscore(F.col(f)).alias(f) for f in factors))
    filled = [F.coalesce(f, F.lit(0.0)) for f in factors]
    some = [F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in factors]
    return p.withColumn("equal", F.try_divide(sum(filled[1:], filled[0]), sum(some[1:], some[0])))


def plan(counts: dict[int, int], dates: list[int], factors: int, r: Rolling) -> tuple[dict[int, list[int]], dict[int, int]]:
    """({model: dates it learns from}, {rebalance date: model}) from the number of whole rows of every date; a model is named by the date of its fit."""
    models, used, last = {}, {}, None
    for t in dates:
        if last is None or t - last >= r.refit:
            known = [d for d in range(t - r.horizon, t - r.horizon - r.lookback, -r.stride) if counts.get(d, 0) >= 8][: r.most_groups]
            rows = sum(min(counts[d], r.boost.group or counts[d]) for d in known)
            if t >= r.lookback + r.horizon - 1 and len(known) >= r.least_groups and rows >= max(r.least_rows, 80 * factors):
                models[t], last = known, t
        if last is not None:
            used[t] = last
    return models, used


def smoothed(scores: DataFrame, rate: float) -> DataFrame:
    """(t, symbol, score) with every score mixed with the symbol's last smoothed one, where both dates have one."""
    last = lambda done: F.element_at(done, -1)["score"]
    mixed = lambda done, x: F.when((F.size(done) > 0) & last(done).isNotNull(), (1 - rate) * x["score"] + rate * last(done)).otherwise(x["score"])
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("t", "score"))), F.array().cast("array<struct<t:int,score:double>>"),
        lambda done, x: F.concat(done, F.array(F.struct(x["t"].alias("t"), F.when(F.size(done) == 0, x["score"]).otherwise(mixed(done, x)).alias("score")))),
    )
    return scores.groupBy("symbol").agg(fold.alias("s")).select("symbol", F.explode("s").alias("s")).select("s.t", "symbol", "s.score")


def rolling_scores(panel: DataFrame, factors: dict[str, int], dates: list[int], r: Rolling = Rolling(), mask: str = "in_universe") -> DataFrame:
    """panel(t, symbol, close, ``mask``, factors), dense -> (t, symbol, score, model) on the rebalance ``dates``; ``factors``: name -> sign.

    ``model`` is the session of the fit, null where the score is the equal-weight one.
    """
    spark, names = panel.sparkSession, list(factors)
    base = staged(prepared(panel, factors, r.horizon, mask))
    whole = base.where("inside").dropna(subset=[*names, "y"])
    counts = dict(whole.groupBy("t").count().collect())
    models, used = plan(counts, sorted(dates), len(names), r)
    on = spark.createDataFrame([(t, used.get(t)) for t in dates], "t int, model int")
    today = base.join(F.broadcast(on), "t")
    if not models:
        out = today.select("t", "symbol", F.col("equal").alias("score"), "model")
        return smoothed(out, r.smooth).withColumn("model", F.lit(None).cast("int"))
    learn = F.broadcast(spark.createDataFrame([(m, t) for m, ts in models.items() for t in ts], "model int, t int"))
    rows = staged(boosting.learn_rows(whole.join(learn, "t"), names, "y", r.boost))
    cuts = boosting.edges(rows, len(names), r.boost)
    packed = staged(boosting.pack(rows, cuts))
    forests = boosting.fit(packed, cuts, r.boost)
    discard(rows), discard(packed)
    scored = boosting.predict(today.where("inside").select("t", "symbol", "model", "equal", *names), names, forests)
    return finished(today.select("t", "symbol"), scored.withColumnRenamed("tree", "raw"), r.blend, r.smooth)


def finished(grid: DataFrame, scored: DataFrame, blend: float, smooth: float) -> DataFrame:
    """(t, symbol, score, model) of all (t, symbol) in ``grid``: ``raw`` model scores as z-scores, blended with ``equal`` and smoothed; a date without a score breaks the smoothing."""
    z = scored.withColumn("z", zscore(F.col("raw")))
    mixed = F.when(F.col("z").isNull(), F.col("equal")).otherwise(F.when(F.col("equal").isNull(), F.col("z")).otherwise((1 - blend) * F.col("equal") + blend * F.col("z")))
    out = staged(z.select("t", "symbol", mixed.alias("score"), F.when(F.col("z").isNotNull(), F.col("model")).alias("model")))
    whole = grid.join(out, ["t", "symbol"], "left").select("t", "symbol", "score")
    return smoothed(whole, smooth).join(out.select("t", "symbol", "model"), ["t", "symbol"], "left")


def picks(scores: DataFrame, n: int) -> DataFrame:
    """(t, symbol, score, weight): the ``n`` best of each date, equal weights; ties by symbol."""
    k = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "symbol"))
    top = scores.where("score is not null").withColumn("k", k).where(F.col("k") <= n)
    return top.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("t"))).drop("k")


def bounded_picks(scores: DataFrame, n: int, bound: float) -> DataFrame:
    """scores(t, symbol, score, size) -> (t, symbol, weight, feasible, swaps): ``n`` symbols of each date with high scores and a mean size within +-``bound``.

    From the ``n`` best, the holding with the most extreme size gives way to the best-scored symbol that brings the mean nearer to zero until the
    bound holds; then the swap that gains most score inside the bound is made until no single swap is left.  Where no single swap
    reaches it any more, ``feasible`` is false.  Symbols without score or size are not picked; ties to the smaller symbol.  A date is one group.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "symbol"], ascending=[False, True])
        x, z = pdf["score"].to_numpy(float), pdf["size"].to_numpy(float)
        k = min(n, len(x))
        held, swaps = np.arange(len(x)) < k, 0
        while abs(z[held].mean()) > bound:
            now = z[held].mean()
            drop = np.flatnonzero(held)[np.argmax(np.sign(now) * z[held])]
            nearer = np.flatnonzero(~held & (np.abs(now + (z - z[drop]) / k) < abs(now) - 1e-12))  # so it ends
            add = nearer[0] if len(nearer) else None
            if add is None:  # any pair that helps
                i, j = np.flatnonzero(held), np.flatnonzero(~held)
                mean = np.abs(now + (z[j][None, :] - z[i][:, None]) / k)
                if not mean.size or mean.min() >= abs(now) - 1e-12:
                    break
                a, b = np.unravel_index(mean.argmin(), mean.shape)
                drop, add = i[a], j[b]
            held[drop], held[add], swaps = False, True, swaps + 1
        feasible = abs(z[held].mean()) <= bound
        while feasible:
            i, j = np.flatnonzero(held), np.flatnonzero(~held)
            gain = x[j][None, :] - x[i][:, None]
            mean = z[held].mean() + (z[j][None, :] - z[i][:, None]) / k
            gain[(np.abs(mean) > bound) | (gain <= 1e-12)] = -np.inf
            if not gain.size or not np.isfinite(gain.max()):
                break
            a, b = np.unravel_index(gain.argmax(), gain.shape)
            held[i[a]], held[j[b]], swaps = False, True, swaps + 1
        return pdf.loc[held, ["t", "symbol"]].assign(weight=1 / k, feasible=bool(feasible), swaps=swaps)

    return scores.select("t", "symbol", "score", "size").dropna().groupBy("t").applyInPandas(kernel, "t int, symbol long, weight double, feasible boolean, swaps int")
