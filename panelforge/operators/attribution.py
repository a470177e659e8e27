"""Attribution tree: the active return split over a hierarchy down to single assets, linked over days, every parent the sum of its children.

A node's own effect is what the portfolio gains by weighing it differently from the benchmark inside its parent:
``(Wp - Wb * Wp_parent / Wb_parent) * (Rb - Rb_parent)``; at the leaves, whose benchmark return is their own, that is selection.  Summed over
all levels the effects telescope to the portfolio's return less the benchmark's, day by day, whatever the hierarchy.  A node that the
benchmark doesn't hold takes its parent's benchmark return (a leaf its own).  Days are linked by logarithmic factors, so that the root is the difference
of the compounded returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.stage import discard, staged


def daily_effects(rows: DataFrame, levels: list[str], day: str = "t") -> DataFrame:
    """rows(day, levels, wp, wb, r), one a leaf (the last level) -> (day, level, levels, effect): own effect of every node; deeper levels null.

    Null weights count as 0; leaves without return take no part; weights are taken as they are (a rest to 1 is cash with return 0).
    """
    rows = rows.where("r is not null").withColumn("wp", F.coalesce("wp", F.lit(0.0))).withColumn("wb", F.coalesce("wb", F.lit(0.0)))
    rows = rows.withColumn("p0", F.sum("wp").over(Window.partitionBy(day))).withColumn("b0", F.sum("wb").over(Window.partitionBy(day)))
    rows = rows.withColumn("r0", F.coalesce(F.try_divide(F.sum(F.col("wb") * F.col("r")).over(Window.partitionBy(day)), F.col("b0")), F.lit(0.0)))
    for k in range(1, len(levels) + 1):
        w = Window.partitionBy(day, *levels[:k])
        here = F.try_divide(F.sum(F.col("wb") * F.col("r")).over(w), F.sum("wb").over(w))
        rows = rows.withColumn(f"p{k}", F.sum("wp").over(w)).withColumn(f"b{k}", F.sum("wb").over(w))
        rows = rows.withColumn(f"r{k}", F.coalesce(here, F.col("r" if k == len(levels) else f"r{k - 1}")))
        fair = F.coalesce(F.try_divide(F.col(f"b{k}") * F.col(f"p{k - 1}"), F.col(f"b{k - 1}")), F.lit(0.0))
        rows = rows.withColumn(f"e{k}", (F.col(f"p{k}") - fair) * (F.col(f"r{k}") - F.col(f"r{k - 1}")))
    kinds = dict(rows.dtypes)
    out = None
    for k in range(1, len(levels) + 1):
        part = rows.groupBy(day, *levels[:k]).agg(F.first(f"e{k}").alias("effect"))
        part = part.select(day, F.lit(k).alias("level"), *levels[:k], *(F.lit(None).cast(kinds[c]).alias(c) for c in levels[k:]), "effect")
        out = part if out is None else out.unionByName(part)
    return out


def link_factors(rows: DataFrame, day: str = "t") -> DataFrame:
    """(day, factor): a day's effects times this add up over days to the difference of the compounded returns; one row a day."""
    total = rows.where("r is not null").groupBy(day).agg(F.coalesce(F.sum(F.col("wp") * F.col("r")), F.lit(0.0)).alias("rp"), F.coalesce(F.sum(F.col("wb") * F.col("r")), F.lit(0.0)).alias("rb"))

    def slope(a: Column, b: Column, log_a: Column, log_b: Column) -> Column:
        """(log_a - log_b) / (a - b), its limit where they meet."""
        return F.when(F.abs(a - b) > 1e-12, (log_a - log_b) / (a - b)).otherwise(1 / (1 + a))

    total = total.withColumn("lp", F.log1p("rp")).withColumn("lb", F.log1p("rb"))
    whole = total.agg(F.sum("lp").alias("sp"), F.sum("lb").alias("sb"))
    k = slope(F.expm1("sp"), F.expm1("sb"), F.col("sp"), F.col("sb"))
    return total.crossJoin(F.broadcast(whole)).select(day, (slope(F.col("rp"), F.col("rb"), F.col("lp"), F.col("lb")) / k).alias("factor"))  # one row


def tree(rows: DataFrame, levels: list[str], day: str = "t") -> DataFrame:
    """(level, levels, effect, subtotal, residual): linked own effect of every node, with all its descendants, and the latter less the
    sum over its children and itself (zero but for rounding); level 0 is the root."""
    rows = staged(rows.where(" AND ".join(f"{c} IS NOT NULL" for c in levels)).select(day, *levels, "wp", "wb", "r"))
    linked = daily_effects(rows, levels, day).join(F.broadcast(link_factors(rows, day)), day)
    own = staged(linked.groupBy("level", *levels).agg(F.sum(F.col("effect") * F.col("factor")).alias("effect")))
    discard(rows)
    root = own.agg(F.sum("effect").alias("subtotal")).select(F.lit(0).alias("level"), *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in levels), F.lit(0.0).alias("effect"), "subtotal")
    out = root
    for k in range(1, len(levels) + 1):
        below = own.where(F.col("level") >= k).groupBy(*levels[:k]).agg(F.sum("effect").alias("subtotal"))
        out = out.unionByName(own.where(F.col("level") == k).join(below, levels[:k]).select("level", *levels, "effect", "subtotal"))
    up = out.where("level > 0").select((F.col("level") - 1).alias("level"), *(F.when(F.col("level") - 1 >= k + 1, F.col(c)).alias(c) for k, c in enumerate(levels)), "subtotal")
    children = up.groupBy("level", *levels).agg(F.sum("subtotal").alias("children"))
    same = [out["level"] == children["level"], *(out[c].eqNullSafe(children[c]) for c in levels)]
    j = out.join(children, same, "left").select(*(out[c] for c in out.columns), "children")
    return j.select("level", *levels, "effect", "subtotal", (F.col("subtotal") - F.col("effect") - F.coalesce("children", F.lit(0.0))).alias("residual"))
