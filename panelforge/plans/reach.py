"""Incremental factors: how far a changed cell reaches through a plan, and the refresh of just those dates.

Every node of a plan hands on, for each field below it, how many calendar rows back and ahead it looks and whether it compares
symbols of a date.  A changed cell (symbol, t, field) makes the outputs from ``t - ahead`` to ``t + back`` stale: of its symbol, or of all symbols where
the field passes a comparison.  ``Refresh`` reads the rows these outputs need, recomputes them and keeps every other stored row.  Recursions,
running totals and carried values look back over the whole history (``WHOLE``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.expression import Node, Plan
from panelforge.sources.stage import discard, staged

WHOLE = 1 << 24  # more rows than any calendar has


class Reach(NamedTuple):
    back: int = 0
    ahead: int = 0
    across: bool = False

    def also(self, other: Reach) -> Reach:
        return Reach(max(self.back, other.back), max(self.ahead, other.ahead), self.across or other.across)

    def through(self, n: Node) -> Reach:
        """As seen from above node ``n``."""
        if n.kind in "xg":
            return self._replace(across=True)
        if n.kind == "r" or n.op in ("cumsum", "ffill"):
            return self._replace(back=WHOLE)
        if n.op == "lead":
            return self._replace(ahead=self.ahead + n.value)
        if n.kind == "s":
            return self._replace(back=min(WHOLE, self.back + n.value - (n.op != "lag")))
        return self


def node_reach(n: Node, seen: dict[int, dict[str, Reach]] | None = None) -> dict[str, Reach]:
    """Reach of one node by field."""
    seen = {} if seen is None else seen
    if id(n) not in seen:
        below: dict[str, Reach] = {n.value: Reach()} if n.op == "field" else {}
        for a in n.args:
            for field, r in node_reach(a, seen).items():
                below[field] = below.get(field, Reach()).also(r)
        if n.op == "slope":
            below["t"] = below.get("t", Reach())
        seen[id(n)] = {field: r.through(n) for field, r in below.items()}
    return seen[id(n)]


def reach(plan: Plan) -> dict[str, dict[str, Reach]]:
    """By formula and field, as ``Plan.long`` gives it (a row needs its own close)."""
    seen: dict[int, dict[str, Reach]] = {}
    out = {}
    for name, root in plan.roots.items():
        out[name] = dict(node_reach(root, seen))
        out[name]["close"] = out[name].get("close", Reach())
    return out


def signature(n: Node) -> str:
    """A formula as it is computed: equal for equal plans, whatever the spelling or the definitions it used."""
    return f"{n.op}[{n.value}]({','.join(signature(a) for a in n.args)})"


def signatures(plan: Plan) -> dict[str, str]:
    return {k: signature(r) for k, r in plan.roots.items()}


def changes(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(symbol, t, field) of cells that differ between two dense panels, with ``t`` of the new one; a null symbol stands for all.

    Rows are met by (symbol, trade_date).  A date in one calendar only moves the rows of every symbol, so it changes all cells there; a date that
    went counts for the session before and after it.  Nulls are values; a symbol in one panel only is compared with nulls.
    """
    pick = lambda f, s: f.select("symbol", "trade_date", F.col("t").alias(f"t{s}"), *(F.col(c).alias(f"{c}_{s}") for c in fields if c != "t"))
    differs = lambda c: F.when(~F.col("to").eqNullSafe(F.col("tn")) if c == "t" else ~F.col(f"{c}_o").eqNullSafe(F.col(f"{c}_n")), F.lit(c))
    both = pick(old, "o").join(pick(new, "n"), ["symbol", "trade_date"], "full")
    cells = both.select("symbol", "trade_date", F.explode(F.array_compact(F.array(*map(differs, fields)))).alias("field"))
    dates = lambda f, s: f.groupBy("trade_date").agg(F.first("t").alias(s))
    calendar = dates(new, "t").join(dates(old, "o"), "trade_date", "full")  # as many rows as there are sessions
    # dates that went take the session after them, or the last one
    calendar = calendar.withColumn("next", F.first("t", ignorenulls=True).over(Window.orderBy("trade_date").rowsBetween(0, Window.unboundedFollowing)))
    calendar = calendar.withColumn("next", F.coalesce("next", F.max("t").over(Window.orderBy(F.lit(0)))))
    moved = calendar.where("t IS NULL OR o IS NULL").select(F.explode(F.when(F.col("t").isNull(), F.array(F.greatest(F.col("next") - 1, F.lit(0)), F.col("next"))).otherwise(F.array("t"))).alias("t"))
    moved = moved.select(F.lit(None).cast("long").alias("symbol"), "t", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return cells.join(F.broadcast(dates(new, "t")), "trade_date").select("symbol", "t", "field").unionByName(moved).distinct()


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching [lo, hi] of a key as one; equal starts are folded first, so a key has at most a calendar of rows."""
    w = Window.partitionBy(*keys).orderBy("lo")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = intervals.groupBy(*keys, "lo").agg(F.max("hi").alias("hi")).withColumn("_new", F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1)))
    return starts.withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


class Refresh:
    """Stored factors of ``old`` brought to ``new`` (dense panels of one shape).

    ``known`` holds the signatures the stored factors were computed with; a factor with another one, or none, is recomputed over all dates.
    Without it the stored factors are taken to be of this plan.  The result equals ``plan.long(new)``: windows over a symbol see the same rows in the same order;
    sums over a date have no fixed order in Spark and agree to the rounding of ``Plan.long``.
    """

    def __init__(self, plan: Plan, old: DataFrame, new: DataFrame, known: dict[str, str] | None = None):
        self.plan, self.new, self.spark = plan, new, new.sparkSession
        by_field = reach(plan)
        now = signatures(plan)
        anew = [f for f in now if known is not None and known.get(f) != now[f]]
        self.calendar = new.groupBy("trade_date").agg(F.first("t").alias("t"))
        last = self.calendar.agg(F.max("t")).first()[0]
        self.last = -1 if last is None else last
        rows = [(f, field, *r) for f, fields in by_field.items() for field, r in fields.items()]
        table = self.spark.createDataFrame(rows, "factor string, field string, back int, ahead int, across boolean")
        met = changes(old, new, sorted({r[1] for r in rows})).join(F.broadcast(table), "field")  # formulas x fields
        hit = met.select("factor", F.when(~F.col("across"), F.col("symbol")).alias("symbol"), F.greatest(F.col("t") - F.col("ahead"), F.lit(0)).alias("lo"), F.least(F.col("t") + F.col("back"), F.lit(self.last)).alias("hi"))
        whole = self.spark.createDataFrame([(f, None, 0, self.last) for f in anew], "factor string, symbol long, lo int, hi int")
        self.stale = staged(merged(hit.unionByName(whole.where("hi >= 0")), ["factor", "symbol"]))
        need = {f: Reach().also(Reach(max(r.back for r in d.values()), max(r.ahead for r in d.values()), any(r.across for r in d.values()))) for f, d in by_field.items()}
        self.need = self.spark.createDataFrame([(f, *r) for f, r in need.items()], "factor string, back int, ahead int, across boolean")

    def inputs(self) -> DataFrame:
        """Rows of the new panel that the stale outputs look at."""
        wide = self.stale.join(F.broadcast(self.need), "factor").select(
            F.when(~F.col("across"), F.col("symbol")).alias("symbol"), F.greatest(F.col("lo") - F.col("back"), F.lit(0)).alias("lo"), F.least(F.col("hi") + F.col("ahead"), F.lit(self.last)).alias("hi"),
        )
        wide = merged(wide, ["symbol"])
        lo, hi = wide.agg(F.min("lo"), F.max("hi")).first()
        if lo is None:
            return self.new.limit(0)
        at = wide.select("symbol", F.explode(F.sequence("lo", "hi")).alias("t"))
        days = at.where("symbol IS NULL").select("t", F.lit(True).alias("_day"))  # at most a calendar
        cells = at.where("symbol IS NOT NULL").withColumn("_cell", F.lit(True))
        rows = self.new.where(F.col("t").between(lo, hi)).join(F.broadcast(days), "t", "left").join(cells, ["symbol", "t"], "left")
        return rows.where("_day OR _cell").select(*self.new.columns)

    def run(self, stored: DataFrame) -> DataFrame:
        """symbol, trade_date, factor, value of the plan on the new panel from ``stored``, the same columns on the old one."""
        at = self.stale.select("factor", "symbol", F.explode(F.sequence("lo", "hi")).alias("t")).join(F.broadcast(self.calendar), "t")
        days = at.where("symbol IS NULL").select("factor", "trade_date", F.lit(True).alias("_day"))  # factors x calendar
        cells = at.where("symbol IS NOT NULL").select("factor", "symbol", "trade_date", F.lit(True).alias("_cell"))
        mark = lambda f: f.join(days, ["factor", "trade_date"], "left").join(cells, ["factor", "symbol", "trade_date"], "left")
        columns = ["symbol", "trade_date", "factor", "value"]
        kept = stored.where(F.col("factor").isin(list(self.plan.roots))).join(F.broadcast(self.calendar.select("trade_date")), "trade_date", "left_semi")
        kept = mark(kept).where("_day IS NULL AND _cell IS NULL").select(*columns)
        return kept.unionByName(mark(self.plan.long(self.inputs())).where("_day OR _cell").select(*columns))

    def close(self) -> None:
        discard(self.stale)
