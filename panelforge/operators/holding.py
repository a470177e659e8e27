"""Holding rules of a rotation as keyed state: least holding time, daily stop, one swap a day, defensive asset.

Candidates, prices and votes of a session are packed by Spark into one small row a (strategy, session); then each strategy walks its
sessions in order.  Every row it writes is the whole state after that session, so the written history is the saved state: a later run continues
from each strategy's last row and reads newer sessions only.  The parallelism is the number of strategies.

A target of a session is held from the next one on.  Rules of a session, the first that applies decides:
1. the first holding closes below ``stop`` times its entry price, or did so in the last ``defence`` sessions: defensive asset;
2. no rebalance session: the last target goes on;
3. holdings are younger than ``least_hold`` sessions: they stay;
4. fewer than ``candidates`` candidates, all scoring below ``weak_score``, or none: defensive asset;
5. the best candidates; in a strong market a holding stays while it scores ``keep`` of the n-th best (and is among the ``depth`` best, where that is given);
   a portfolio of which nothing stays buys one asset a session.

The weak-market period is part of the state, since it rests while the defence lasts.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = "strategy string, t int, reason string, target array<long>, held array<long>, since int, entry double, defence int, weak int"
_FIELDS = [c.split()[0] for c in HISTORY.split(", ")]


@dataclass(frozen=True)
class Rules:
    n: int = 1
    least_hold: int = 5
    keep: float = 0.8
    stop: float = 0.95
    defence: int = 3
    candidates: int = 2
    weak_score: float = 0.3
    longest: int = 20  # sessions of a weak period
    need: int = 3  # votes that start or end one
    depth: int | None = None  # a holding stays only among so many best


def packed(candidates: DataFrame, prices: DataFrame, votes: DataFrame, strategies: DataFrame, rebalance: Column, front: int = 10) -> DataFrame:
    """One row a (strategy, t) of all sessions with prices.

    candidates(strategy, t, symbol, score, strong, weak): whether a symbol passes in either market; prices(strategy, t, symbol, open, close);
    votes(t, below, above, valid); strategies(strategy, defensive); ``rebalance``: condition on t.
    A session lists its ``front`` best of either market (twice the holdings or more, as no more can be bought) and every candidate that can be held by then, whatever its place:
    those that were in front in any session, and the defensive asset.
    """
    c = candidates.select("strategy", "t", "symbol", "score", F.explode(F.array(*(F.struct(F.lit(x).alias("market"), F.col(x).alias("ok")) for x in ("strong", "weak")))).alias("m"))
    w = Window.partitionBy("strategy", "t", "m.market")
    c = c.where("m.ok and score is not null").withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "symbol"))).withColumn("many", F.count("*").over(w))
    # only what can be held needs a price or, beyond the front, a place
    held = c.where(F.col("k") <= front).select("strategy", "symbol").union(strategies.select("strategy", F.col("defensive"))).distinct()
    c = c.join(held, ["strategy", "symbol"], "left_semi")
    market = lambda name: F.col("m.market") == name
    listed = lambda name: F.array_sort(F.collect_list(F.when(market(name), F.struct("k", "symbol", "score"))))
    best = c.groupBy("strategy", "t").agg(listed("strong").alias("strong"), listed("weak").alias("weak_list"), F.max(F.when(market("strong"), F.col("many"))).alias("many"), F.max(F.when(market("weak"), F.col("many"))).alias("weak_many"))
    quotes = prices.join(held, ["strategy", "symbol"], "left_semi").groupBy("strategy", "t").agg(F.collect_list(F.struct("symbol", "open", "close")).alias("quotes"))
    base = prices.select("strategy", "t").distinct().join(strategies, "strategy")
    out = base.join(quotes, ["strategy", "t"], "left").join(best, ["strategy", "t"], "left").join(F.broadcast(votes.select("t", "below", "above", "valid")), "t", "left")
    return out.withColumn("rebalance", rebalance)


def weak_after(start: int | None, t: int, below: int, above: int, enough: int, longest: int) -> int | None:
    if start is not None and (t - start + 1 >= longest or above >= enough):
        return None
    return t if below >= enough else start


def choose(best: list[tuple[int, float]], held: list[int], keep: float, n: int) -> list[int]:
    """best: (symbol, score) by falling score -> up to n symbols, holdings close to the n-th best first; where no holding stays, one asset only."""
    if not best:
        return []
    floor = best[n - 1][1] * keep if len(best) >= n else None
    near = [(s, x) for s, x in best if floor is None or x >= floor]
    stay = [s for s, _ in near if s in held][:n]
    if len(stay) < n:
        stay = [h for h in held if h in stay]
    want = stay + [s for s, _ in near if s not in stay][: n - len(stay)]
    kept, new = [h for h in held if h in want], [s for s in want if s not in held]
    if not held or not kept:
        return want if not held else new[:1]
    return kept + new[: n - len(kept)]


def step(state: dict, row: dict, r: Rules) -> dict:
    """State after a session from the state before; see the rules above."""
    t, quotes = row["t"], {q["symbol"]: (q["open"], q["close"]) for q in row["quotes"]}
    held = sorted(state["target"])
    since, entry, defence, weak = state["since"], state["entry"], state["defence"], state["weak"]
    if held != state["held"]:
        open_, close = quotes.get(held[0], (None, None)) if held else (None, None)
        since, entry = (t if held else None), (open_ if open_ is not None and open_ > 0 else close)
    close = quotes.get(held[0], (None, None))[1] if held else None
    if entry and close and entry > 0 and 0 < close < entry * r.stop:
        defence = t
    if defence is not None and t - defence + 1 > r.defence:
        defence = None
    q = quotes.get(row["defensive"])
    safe = [row["defensive"]] if q and q[1] is not None else []
    if defence is None:
        enough = r.need if row["valid"] < 2 else min(r.need, row["valid"])
        weak = weak_after(weak, t, row["below"], row["above"], enough, r.longest)
        best = row["strong"] if weak is None else row["weak_list"]
        if r.depth is not None:
            best = [b for b in best if b["k"] <= r.depth]
        many = (row["many"] if weak is None else row["weak_many"]) or 0
    if defence is not None:
        reason, target = "stop", safe
    elif not row["rebalance"]:
        reason, target = "between", state["target"]
    elif held and since is not None and t - since + 1 < r.least_hold:
        reason, target = "young", held[: r.n]
    elif not best or (many < r.candidates and best[0]["score"] < r.weak_score):
        reason, target = "few", safe
    else:
        target = choose([(b["symbol"], b["score"]) for b in best], held, r.keep if weak is None else 1.0, r.n)
        reason = "best" if target else "few"
        target = target or safe
    return {"strategy": row["strategy"], "t": t, "reason": reason, "target": sorted(target), "held": held, "since": since, "entry": entry, "defence": defence, "weak": weak}


def walk(rows: DataFrame, rules: Rules = Rules(), history: DataFrame | None = None) -> DataFrame:
    """Packed sessions -> HISTORY rows; ``history``: rows of an earlier run, after whose last session of each strategy this one continues."""
    if history is not None:
        last = history.groupBy("strategy").agg(F.max_by(F.struct(*_FIELDS), "t").alias("state"))
        rows = rows.join(last, "strategy", "left").where("state is null or t > state.t")
    else:
        rows = rows.withColumn("state", F.lit(None).cast(f"struct<{HISTORY.replace(' ', ':').replace(',:', ',')}>"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        now = lambda v: None if v is None or v != v else int(v)
        out, state = [], {"target": [], "held": [], "since": None, "entry": None, "defence": None, "weak": None}
        first = pdf["state"].iloc[0]
        if first is not None:
            first = first if isinstance(first, dict) else first.asDict()
            state = {k: first[k] for k in state} | {"target": [int(s) for s in first["target"]], "held": [int(s) for s in first["held"]]} | {k: now(first[k]) for k in ("since", "defence", "weak")}
        for row in pdf.sort_values("t").to_dict("records"):
            for c in ("quotes", "strong", "weak_list"):
                row[c] = [] if row[c] is None else list(row[c])
            for c in ("below", "above", "valid", "many", "weak_many"):
                row[c] = now(row[c]) or 0
            state = step(state, row, rules)
            out.append([state[f] for f in _FIELDS])
        frame = pd.DataFrame(out, columns=_FIELDS)
        for c in ("since", "defence", "weak"):
            frame[c] = pd.array(frame[c], dtype="Int32")
        return frame

    return rows.groupBy("strategy").applyInPandas(kernel, HISTORY)


def replay(history: DataFrame) -> DataFrame:
    """(strategy, t, symbol, weight, current): each strategy's last target at equal weights, and what it holds at that session's close."""
    last = history.groupBy("strategy").agg(F.max_by(F.struct("t", "target", "held"), "t").alias("s"))
    both = last.select("strategy", "s.t", F.explode(F.array_union("s.target", "s.held")).alias("symbol"), "s.target", "s.held")
    share = lambda c: F.when(F.array_contains(c, F.col("symbol")), 1 / F.size(c)).otherwise(0.0)
    return both.select("strategy", "t", "symbol", share("target").alias("weight"), share("held").alias("current"))
