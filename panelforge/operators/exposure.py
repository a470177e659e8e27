"""Exposure engine: standardised styles, cross-sectional regressions on styles and an industry block, attribution.

Everything is windows over a date's rows, which share one exchange, and sums.  The industry dummies are never built: a regression
with a constant for each industry has the same coefficients as one of columns that are centred within industries, so only the
small Gram matrix of the styles is summed (Spark aggregates) and solved, one row a regression; the constants follow
from the means.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGMA, LEAST = 2.5, 20


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def standardise(df: DataFrame, styles: dict[str, str], size: str, mask: str | Column = "in_universe", day: str = "trade_date", sigma: float = SIGMA, least: int = LEAST) -> DataFrame:
    """``df`` with a standardised column for each style (name -> raw column), ``nlsize`` and the weight ``cap``.

    Inside the mask: values beyond ``sigma`` equal-weight deviations go to the border, the capitalisation-weighted mean (weights
    exp of ``size``, a style) goes, and the equal-weight deviation divides.  ``nlsize`` is the weighted residual of the cubed size on the
    size, standardised.  A style with fewer than ``least`` values on a day, or no variance, is null there.
    """
    d = Window.partitionBy(day)
    inside = F.col(mask) if isinstance(mask, str) else mask
    out = df.select("*", *(F.when(inside, F.col(c)).alias(f"{s}_0") for s, c in styles.items()))
    out = out.withColumn("cap", F.exp(F.when(F.col(f"{size}_0").isNotNull(), F.greatest(F.least(F.col(f"{size}_0"), F.lit(40.0)), F.lit(-40.0)))))
    names = list(styles)
    for s in names:
        x = F.col(f"{s}_0")
        mu, sd = F.avg(x).over(d), F.stddev_pop(x).over(d)
        cut = F.least(F.greatest(x, mu - sigma * sd), mu + sigma * sd)
        out = out.withColumn(f"{s}_1", F.when(x.isNotNull() & (F.count(x).over(d) >= least) & (sd > 1e-12), cut).otherwise(x))

    def centred(frame: DataFrame, source: str, name: str) -> DataFrame:
        x = F.col(source)
        w = F.when(x.isNotNull(), F.col("cap"))
        sd = F.stddev_pop(x).over(d)
        z = (x - F.try_divide(F.sum(w * x).over(d), F.sum(w).over(d))) / sd
        return frame.withColumn(name, F.when((F.count(x).over(d) >= least) & (sd > 1e-12), z))

    for s in names:
        out = centred(out, f"{s}_1", s)
    x, y = F.col(size), F.pow(F.col(size), F.lit(3.0))
    w = F.when(x.isNotNull(), F.col("cap"))
    mean = lambda c: F.try_divide(F.sum(w * c).over(d), F.sum(w).over(d))
    out = out.withColumn("mx", mean(x)).withColumn("my", mean(y))
    out = out.withColumn("b", F.try_divide(F.sum(w * (x - F.col("mx")) * (y - F.col("my"))).over(d), F.sum(w * (x - F.col("mx")) * (x - F.col("mx"))).over(d)))
    out = centred(out.withColumn("nl_0", y - F.col("my") - F.col("b") * (x - F.col("mx"))), "nl_0", "nlsize")
    return out.select(*df.columns, *names, "nlsize", "cap")


def industries(df: DataFrame, column: str) -> list:
    """The industries of a panel, the most populous (of equal ones the first) in front: the reference."""
    return [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).collect()]


class Regression:
    """y on a constant, ``xs`` and an industry block, one regression for each value of ``keys``.

    Rows with a missing part take no part; ``blocks`` (see ``industries``) are the industries in play, None for no industry block.  ``scaled``: y is
    replaced by its equal-weight z-score over the regression's rows.  Without ``least`` rows (by default 20 or five more than there are
    columns), or variance of a scaled y, there is no result.  Collinear columns get the coefficients of least norm.
    """

    def __init__(self, df: DataFrame, y: str, xs: list[str], keys: list[str], industry: str | None = None, blocks: list | None = None, weight: str | None = None, scaled: bool = False, least: int | None = None):
        self.xs, self.keys, self.blocks = xs, keys, blocks or []
        width = len(xs) + max(len(self.blocks) - 1, 0)
        floor = max(LEAST, width + 5) if least is None else least
        g = F.col(industry) if industry else F.lit(0)
        w = F.col(weight) if weight else F.lit(1.0)
        rows = df.select(*keys, "symbol", g.alias("g"), w.alias("w"), F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)))
        rows = rows.dropna(subset=["g", "w", "y", *(f"x{i}" for i in range(len(xs)))]).where("w > 0")
        whole, block = Window.partitionBy(*keys), Window.partitionBy(*keys, "g")
        rows = rows.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= floor)
        if scaled:
            rows = rows.withColumn("sd", F.stddev_pop("y").over(whole)).withColumn("y", (F.col("y") - F.avg("y").over(whole)) / F.when(F.col("sd") > 1e-12, F.col("sd"))).where("y is not null")
        cols = ["y", *(f"x{i}" for i in range(len(xs)))]
        for c in cols:
            rows = rows.withColumn(f"m{c}", F.sum(F.col("w") * F.col(c)).over(block) / F.sum("w").over(block)).withColumn(f"d{c}", F.col(c) - F.col(f"m{c}"))
        self.rows = rows
        pairs = [(a, b) for a in range(len(xs)) for b in range(a, len(xs))]
        gram = [F.sum(F.col("w") * F.col(f"dx{a}") * F.col(f"dx{b}")) for a, b in pairs] + [F.sum(F.col("w") * F.col(f"dx{a}") * F.col("dy")) for a in range(len(xs))]
        means = F.struct("g", "my", F.array(*(F.col(f"mx{i}") for i in range(len(xs)))).alias("mx")).alias("m")
        # one pass for both: a block's sums and means, then the regression's
        part = rows.groupBy(*keys, "g", "my", *(f"mx{i}" for i in range(len(xs)))).agg(*(c.alias(f"s{i}") for i, c in enumerate(gram))).select(*keys, means, *(f"s{i}" for i in range(len(gram))))
        sums = part.groupBy(*keys).agg(F.collect_list("m").alias("levels"), F.array(*(F.sum(f"s{i}") for i in range(len(gram)))).alias("s"))
        kinds = dict(sums.dtypes)
        self.fit = sums.mapInArrow(_solver(len(xs), pairs), ", ".join(f"{k} {kinds[k]}" for k in (*keys, "levels")) + ", beta array<double>")

    def _beta(self, i: int) -> Column:
        return F.get("beta", F.lit(i))

    def residuals(self) -> DataFrame:
        """(keys, symbol, resid)"""
        j = self.rows.join(self.fit.drop("levels"), self.keys)
        return j.select(*self.keys, "symbol", (F.col("dy") - _total([self._beta(i) * F.col(f"dx{i}") for i in range(len(self.xs))])).alias("resid"))

    def coefficients(self) -> DataFrame:
        """(keys, name, beta): intercept, the styles, and ``ind_`` with the industry for all but the reference.

        The reference is the first industry of ``blocks`` that the regression has rows of; industries without rows have coefficient 0.
        """
        order = (lambda g: F.array_position(F.array(*(F.lit(b) for b in self.blocks)), g)) if self.blocks else (lambda g: F.lit(1))
        fall = lambda mx: F.aggregate(F.zip_with("beta", mx, lambda b, m: b * m), F.lit(0.0), lambda t, v: t + v)
        level = F.transform("levels", lambda m: F.struct(order(m["g"]).alias("o"), m["g"].alias("g"), (m["my"] - fall(m["mx"])).alias("a")))
        per = self.fit.select(*self.keys, "beta", F.array_sort(level).alias("levels"))
        per = per.select(*self.keys, "beta", F.get("levels", F.lit(0))["a"].alias("a0"), F.get("levels", F.lit(0))["g"].alias("g0"), F.map_from_entries(F.transform("levels", lambda m: F.struct(m["g"], m["a"]))).alias("levels"))
        named = [F.struct(F.lit("intercept").alias("name"), F.col("a0").alias("beta"))] + [F.struct(F.lit(x).alias("name"), self._beta(i).alias("beta")) for i, x in enumerate(self.xs)]
        named += [F.struct(F.lit(f"ind_{b}").alias("name"), F.when(F.lit(b) != F.col("g0"), F.coalesce(F.try_element_at("levels", F.lit(b)) - F.col("a0"), F.lit(0.0))).alias("beta")) for b in self.blocks]
        return per.select(*self.keys, F.explode(F.array(*named)).alias("c")).select(*self.keys, "c.name", "c.beta").where("beta is not null")


def _solver(k: int, pairs: list[tuple[int, int]]):
    def solve(batches):
        for b in batches:
            out = []
            for s in b.column(b.num_columns - 1).to_pylist():
                a = np.zeros((k, k))
                for (i, j), v in zip(pairs, s, strict=False):
                    a[i, j] = a[j, i] = v
                out.append(np.linalg.lstsq(a, np.array(s[len(pairs) :]), rcond=1e-12)[0] if k else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*b.schema.names[:-1], "beta"])

    return solve


def neutralised(df: DataFrame, score: str, xs: list[str], keys: list[str], mask: str = "in_universe", least: int = 40) -> DataFrame:
    """``df`` with ``score`` replaced by its residual on ``xs`` inside the mask.

    A score without an exposure becomes null there; where fewer than ``least`` (or columns + 8) rows can be fitted, the other scores stay as they are.
    """
    fitted = Regression(df.where(mask), score, xs, keys, least=max(least, len(xs) + 8)).residuals()
    out = df.join(fitted, [*keys, "symbol"], "left")
    whole = reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in xs))
    kept = F.when(F.col(mask), F.when(whole, F.coalesce("resid", score))).otherwise(F.col(score))
    return out.select(*(kept.alias(c) if c == score else F.col(c) for c in df.columns))


def attribution(ev: DataFrame, f: str, r: str, styles: list[str], industry: str, blocks: list, least: int = LEAST, keys: tuple[str, str] = ("trade_date", "factor")) -> DataFrame:
    """Daily attribution (keys, name, f_k, beta, attr) of each factor's return to styles and industries, and the totals.

    ``f_k``: return of a style or industry (r on styles and industries); ``beta``: the scaled factor's exposure to it; ``attr`` their product.
    Rows of name ``factor_return`` (slope of r on the scaled factor), ``explained``, ``residual`` and ``attr_industry`` hold totals in ``attr``.
    """
    day, factor = keys
    valid = ev.where(F.col(f).isNotNull() & F.col(r).isNotNull())
    n, sd = F.count("*"), F.stddev_pop(f)
    slope = valid.groupBy(day, factor).agg(F.when((n >= least) & (sd > 1e-12), F.try_divide(F.covar_pop(f, r), sd)).alias("attr"))
    betas = Regression(ev, f, styles, [day, factor], industry, blocks, scaled=True, least=max(least, len(styles) + len(blocks) + 5)).coefficients()
    day_rows = ev.groupBy(day, "symbol").agg(F.first(r).alias(r), F.first(industry).alias(industry), *(F.first(s).alias(s) for s in styles))
    returns = Regression(day_rows, r, styles, [day], industry, blocks, least=least).coefficients()
    legs = betas.join(returns.withColumnRenamed("beta", "f_k"), [day, "name"]).where("name <> 'intercept'").withColumn("attr", F.col("beta") * F.col("f_k"))
    total = legs.groupBy(day, factor).agg(F.sum("attr").alias("explained"), F.sum(F.when(F.col("name").startswith("ind_"), F.col("attr"))).alias("attr_industry"))
    both = slope.join(total, [day, factor], "left").withColumn("left", F.col("attr") - F.col("explained"))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("attr")) for n, c in (("factor_return", "attr"), ("explained", "explained"), ("attr_industry", "attr_industry"), ("residual", "left"))))
    both = both.select(day, factor, F.explode(rows).alias("x"))
    none = F.lit(None).cast("double")
    return legs.select(day, factor, "name", "f_k", "beta", "attr").unionByName(both.select(day, factor, "x.name", none.alias("f_k"), none.alias("beta"), "x.attr")).where("attr is not null")


def attribution_over_time(daily: DataFrame, window: int = 20, keys: tuple[str, str] = ("trade_date", "factor")) -> DataFrame:
    """Daily attribution with ``cum_attr``, ``cum_f`` and ``ma_f`` (mean of the last ``window`` days, once there are so many) of each leg."""
    day, factor = keys
    w = Window.partitionBy(factor, "name").orderBy(day)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    few = w.rowsBetween(1 - window, 0)
    return daily.select("*", F.sum("attr").over(back).alias("cum_attr"), F.sum("f_k").over(back).alias("cum_f"), F.when(F.count("f_k").over(few) >= window, F.avg("f_k").over(few)).alias("ma_f"))


def attribution_summary(daily: DataFrame, factor: str = "factor") -> DataFrame:
    """(factor, name, n_days, mean_attr, cum_attr, mean_f, residual_share): totals over all days; the share only for ``residual``."""
    out = daily.groupBy(factor, "name").agg(F.count("attr").alias("n_days"), F.avg("attr").alias("mean_attr"), F.sum("attr").alias("cum_attr"), F.avg("f_k").alias("mean_f"))
    base = daily.where("name = 'factor_return'").groupBy(factor).agg(F.sum("attr").alias("base"))
    share = F.when((F.col("name") == "residual") & (F.abs("base") > 1e-12), F.col("cum_attr") / F.col("base"))
    return out.join(base, factor, "left").select(factor, "name", "n_days", "mean_attr", "cum_attr", "mean_f", share.alias("residual_share"))
