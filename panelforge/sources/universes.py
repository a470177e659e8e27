"""Named universes: board rules on the code, index membership as of the latest snapshot, benchmarks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Universes by index, universes by board, benchmark of a board, fallbacks of a benchmark without bars.
INDEX = {"hs300": "000300.SH", "zz500": "000905.SH", "zz1000": "000852.SH", "sz50": "000016.SH", "cyb": "399006.SZ", "zzhz": "000985.SH", "sme": "399101.SZ", "kcb50": "000688.SH"}
BOARDS = ("main", "gem", "star", "bse")
BOARD_BENCHMARK = {"all": "000985.SH", "main": "000985.SH", "gem": "399006.SZ", "star": "000688.SH"}
FALLBACKS = {
    "000985.SH": ("000985.CSI",),
    "000985.CSI": ("000985.SH",),
    "000852.SH": ("399101.SZ", "000510.SH", "000300.SH"),
    "000905.SH": ("000510.SH", "000300.SH"),
    "000016.SH": ("000300.SH",),
    "000688.SH": ("399006.SZ", "000510.SH", "000300.SH"),
}
BROAD = ("000985.SH", "000300.SH", "000001.SH")
PREFIX = (("688", "star"), ("300", "gem"), ("301", "gem"), ("8", "bse"), ("4", "bse"), ("60", "main"), ("00", "main"), ("BJ8", "bse"), ("BJ4", "bse"), ("BJ9", "bse"), ("BJ", "bse"))
NAMES = ("all", *INDEX, *BOARDS)


def board(code: Column) -> Column:
    """Board of a code such as SH600000: the one of the longest prefix that fits; null stays null."""
    digits, exchange = F.regexp_replace(code, "[^0-9]", ""), F.upper(F.substring(code, 1, 2))
    fits = F.filter(F.array(*(F.struct(F.length(F.lit(p)).alias("n"), F.lit(p).alias("p"), F.lit(b).alias("board")) for p, b in PREFIX)), lambda r: F.startswith(F.concat(exchange, digits), r["p"]) | F.startswith(digits, r["p"]))
    return F.when(code.isNotNull(), F.coalesce(F.array_max(fits)["board"], F.lit("other")))


def restricted(name: Column) -> Column:
    """Under special treatment or being delisted, by the name of the day."""
    return F.coalesce(F.upper(name).rlike(r"ST|\*|退"), F.lit(False))


def members(panel: DataFrame, name: str, constituents: DataFrame | None = None) -> DataFrame:
    """Rows of ``panel`` (code, trade_date, …) in the universe.

    An index universe takes the latest snapshot of ``constituents`` (index_code, code, trade_date) not after the day; days before the first have
    no members.  Unknown names and an index without any snapshot are errors.
    """
    if name not in NAMES:
        raise ValueError(f"unknown universe {name!r}; known: {', '.join(NAMES)}")
    if name == "all":
        return panel
    if name in BOARDS:
        return panel.where(board(F.col("code")) == name)
    held = constituents.where(F.col("index_code") == INDEX[name]).select("code", F.col("trade_date").alias("snap")).distinct()
    if held.isEmpty():
        raise ValueError(f"no constituents of {INDEX[name]}")
    days = panel.select("trade_date").distinct().withColumn("snap", F.lit(None).cast(held.schema["snap"].dataType))
    days = days.union(held.select("snap", "snap").distinct())
    w = Window.orderBy("trade_date").rangeBetween(Window.unboundedPreceding, 0)  # one row a session
    snaps = days.select("trade_date", F.max("snap").over(w).alias("snap")).distinct().where("snap is not null")
    return panel.join(snaps.join(held, "snap").select("code", "trade_date"), ["code", "trade_date"], "left_semi")


def benchmark(preferred: str | None, available: Iterable[str]) -> str | None:
    """The first of a preference list that has bars: the preferred index and its fallbacks, or the broad ones and then whatever there is.

    A preferred index without bars and fallbacks stays.
    """
    have = {a for a in available if a}
    wanted = (preferred, *FALLBACKS.get(preferred, ())) if preferred else (*BROAD, *sorted(have))
    place = {b: k for k, b in reversed(list(enumerate(wanted)))}
    return min(have & place.keys(), key=place.__getitem__, default=preferred or None)


def default_benchmark(name: str) -> str | None:
    return INDEX.get(name) or BOARD_BENCHMARK.get(name)


def labelled(panel: DataFrame, constituents: DataFrame) -> DataFrame:
    """``panel`` (code, trade_date, …) with ``universes``, the names of all universes a row is in: one pass over the panel for the thirteen.

    Index members are those of the index's latest snapshot not after the day; an index without snapshots has no members here.
    """
    named = F.element_at(F.create_map(*(F.lit(v) for name, code in INDEX.items() for v in (code, name))), F.col("index_code"))
    held = constituents.select(named.alias("universe"), "code", F.col("trade_date").alias("snap")).where("universe IS NOT NULL").distinct()
    # sessions x indices, as few as the calendar
    days = panel.select("trade_date").distinct().select(F.explode(F.array(*map(F.lit, INDEX))).alias("universe"), "trade_date", F.lit(None).cast(held.schema["snap"].dataType).alias("snap"))
    days = days.unionByName(held.select("universe", F.col("snap").alias("trade_date"), "snap").distinct())
    w = Window.partitionBy("universe").orderBy("trade_date").rangeBetween(Window.unboundedPreceding, 0)
    snaps = days.withColumn("snap", F.max("snap").over(w)).where("snap IS NOT NULL").distinct()
    indices = snaps.join(held, ["universe", "snap"]).groupBy("code", "trade_date").agg(F.collect_set("universe").alias("_in"))
    own = board(F.col("code"))
    always = F.when(own.isin(*BOARDS), F.array(F.lit("all"), own)).otherwise(F.array(F.lit("all")))
    rows = panel.join(indices, ["code", "trade_date"], "left")
    return rows.withColumn("universes", F.sort_array(F.concat(always, F.coalesce("_in", F.array().cast("array<string>"))))).drop("_in")


def investable(panel: DataFrame, names: DataFrame, basics: DataFrame, min_sessions: int = 60, next_open: bool = False) -> DataFrame:
    """Rows of the dense ``panel`` (code, trade_date, t, open) that may be bought.

    Out go: days on which a span of ``names``(code, name, start, end; end inclusive, null bounds are open) restricts the share; the first ``min_sessions`` from the listing date of ``basics``(code,
    list_date, delist_date), all before it, and shares listed after the last session; days on or before whose next session the share is delisted, so for such a share also the last session; days
    without an open, or without the next one.  Shares without names or dates are not judged by them.
    """
    sessions = panel.select("trade_date", "t").distinct()
    listed = basics.select("code", F.col("list_date").alias("trade_date")).where("trade_date IS NOT NULL").groupBy("code").agg(F.min("trade_date").alias("trade_date"))
    # first session not before the listing: dates of both kinds in order, as of the next session; one row a share and session
    order = Window.orderBy(F.desc("trade_date"), F.col("code").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    dates = listed.select("trade_date").distinct().select(F.lit("x").alias("code"), "trade_date", F.lit(None).cast("int").alias("t")).unionByName(sessions.select(F.lit(None).cast("string").alias("code"), "trade_date", F.col("t").cast("int").alias("t")))
    first = dates.withColumn("_ipo", F.min("t").over(order)).where("code IS NOT NULL").select("trade_date", "_ipo")
    ages = listed.join(first, "trade_date").select("code", F.coalesce("_ipo", F.lit(2**31 - 1)).cast("long").alias("_ipo"))
    gone = basics.where("delist_date IS NOT NULL").groupBy("code").agg(F.min("delist_date").alias("_delist"))
    by = Window.partitionBy("code").orderBy("t")
    entry = F.lead("open").over(by) if next_open else F.col("open")
    following = F.coalesce(F.lead("trade_date").over(by), F.lit("9999-12-31").cast("date"))
    rows = panel.withColumns({"_entry": entry, "_next": following}).join(ages, "code", "left").join(gone, "code", "left")
    ok = F.col("_entry").isNotNull() & (F.col("_entry") != 0) & (F.col("_ipo").isNull() | (F.col("t") >= F.col("_ipo") + min_sessions)) & (F.col("_delist").isNull() | (F.col("_next") < F.col("_delist")))
    spans = names.where(restricted(F.col("name"))).select(F.col("code").alias("_code"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    held = (F.col("code") == F.col("_code")) & (F.col("_from").isNull() | (F.col("_from") <= F.col("trade_date"))) & (F.col("_to").isNull() | (F.col("trade_date") <= F.col("_to")))
    return rows.where(ok).join(spans, held, "left_anti").select(*panel.columns)
