"""Portfolio simulation: a day loop per strategy.

State (shares, cash) is sequential in time, so one strategy is one group; strategies run in parallel.  Signals
of session t fill at the open of t + 1.  Sells come first; bought shares can't be sold on the same session; lots of 100;
no buy at the upper limit, no sale at the lower, nothing without an open; buys are scaled to the cash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Commission and stamp duty rates, least fee an order, lot.
COMMISSION, STAMP, LEAST_FEE, LOT = 0.00031, 0.0005, 5.0, 100


def fee(notional: float, sell: bool, commission: float = COMMISSION, stamp: float = STAMP, least: float = LEAST_FEE) -> float:
    return max(notional * (commission + stamp * sell), least) if notional > 0 else 0.0


def affordable(n: float, price: float, cash: float, lot: int = LOT) -> float:
    """The most shares in whole lots, ``n`` at most, that ``cash`` pays with the fee; halving, as a step of one lot is lost in the digits of very large orders."""
    fits = lambda k: k * lot * price + fee(k * lot * price, False) <= cash
    low, high = 0, max(int(n // lot), 0)
    if fits(high):
        return float(high * lot)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return float(low * lot)


def fill(shares: np.ndarray, cash: float, target: np.ndarray, opens: np.ndarray, up: np.ndarray, down: np.ndarray, lot: int = LOT):
    """(shares, cash, trades) after trading from ``shares`` to the target weights at the opens; trades: (asset, signed shares, price, fee)."""
    price = np.nan_to_num(opens)
    open_ = np.isfinite(opens) & (opens > 0)
    worth = cash + float(shares @ price)
    want = np.where(open_, np.floor(target * worth / np.where(open_, price, 1) / lot) * lot, shares)
    trades, shares = [], shares.copy()
    for i in np.flatnonzero(open_ & (want < shares) & ~(opens <= down)):
        n = shares[i] - want[i]
        c = fee(n * price[i], True)
        cash += n * price[i] - c
        shares[i] = want[i]
        trades.append((int(i), -float(n), float(price[i]), c))
    buys = np.flatnonzero(open_ & (want > shares) & ~(opens >= up))
    need = sum((want[i] - shares[i]) * price[i] + fee((want[i] - shares[i]) * price[i], False) for i in buys)
    scale = min(1.0, cash / need) if need > 0 else 0.0
    for i in buys:
        n = affordable(float(np.floor((want[i] - shares[i]) * scale / lot) * lot), float(price[i]), float(cash), lot)
        c = fee(n * price[i], False)
        if n > 0:
            cash -= n * price[i] + c
            shares[i] += n
            trades.append((int(i), float(n), float(price[i]), c))
    return shares, cash, trades


def simulate(pdf: pd.DataFrame, cash: float = 1e6, lot: int = LOT) -> pd.DataFrame:
    """One strategy: rows (t, symbol, open, up_limit, down_limit, weight); weight is the target set at t, null where none is set."""
    wide = {c: pdf.pivot_table(index="t", columns="symbol", values=c, dropna=False, aggfunc="first") for c in ("open", "up_limit", "down_limit", "weight")}
    t, n = wide["open"].index, wide["open"].shape[1]
    shares, last, out, pending, held = np.zeros(n), np.zeros(n), [], None, None
    for k, day in enumerate(t):
        o = wide["open"].iloc[k].to_numpy(float)
        costs = turnover = 0.0
        if pending is not None:
            up = np.nan_to_num(wide["up_limit"].iloc[k].to_numpy(float), nan=np.inf)
            down = np.nan_to_num(wide["down_limit"].iloc[k].to_numpy(float), nan=-np.inf)
            shares, cash, trades = fill(shares, cash, pending, o, up, down, lot)
            costs, turnover = sum(x[3] for x in trades), sum(abs(x[1]) * x[2] for x in trades)
        last = np.where(np.isfinite(o) & (o > 0), o, last)
        out.append((int(day), cash + float(shares @ last), cash, int((shares > 0).sum()), costs, turnover))
        w = wide["weight"].iloc[k].to_numpy(float)
        new = np.nan_to_num(w) if np.isfinite(w).any() else None
        # hold when the target is the one already filled
        pending = None if new is not None and held is not None and np.array_equal(new, held) else new
        held = held if new is None else new
    return pd.DataFrame(out, columns=["t", "equity", "cash", "positions", "fees", "turnover"])


def run(targets: DataFrame, panel: DataFrame, cash: float = 1e6, lot: int = LOT) -> DataFrame:
    """targets(strategy, t, symbol, weight), panel(symbol, t, open, …) -> (strategy, t, equity, cash, positions, fees, turnover)."""
    cols = ["symbol", "t", "open", *(c for c in ("up_limit", "down_limit") if c in panel.columns)]
    # of the panel each strategy gets the symbols that it ever holds
    rows = targets.select("strategy", "symbol").distinct().join(panel.select(*cols), "symbol").join(targets, ["strategy", "symbol", "t"], "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        for c in ("up_limit", "down_limit"):
            if c not in pdf:
                pdf[c] = np.nan
        return simulate(pdf, cash, lot).assign(strategy=pdf["strategy"].iloc[0])[["strategy", "t", "equity", "cash", "positions", "fees", "turnover"]]

    return rows.groupBy("strategy").applyInPandas(kernel, "strategy string, t int, equity double, cash double, positions int, fees double, turnover double")


def performance(equity: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Summary a strategy: total, annualised return, volatility, Sharpe, largest drawdown, Calmar, fees, turnover; set-based."""
    return equity.sparkSession.sql(
        f"""
        SELECT strategy, last / first - 1 AS total, pow(last / first, {per_year} / nullif(n - 1, 0)) - 1 AS annual, vol, mean * {per_year} / nullif(vol, 0e0) AS sharpe, mdd,
          (pow(last / first, {per_year} / nullif(n - 1, 0)) - 1) / nullif(mdd, 0e0) AS calmar, fees, turnover
        FROM (SELECT strategy, min_by(equity, t) AS first, max_by(equity, t) AS last, count(*) AS n, stddev_samp(r) * sqrt({per_year}) AS vol, avg(r) AS mean,
                max(1 - equity / peak) AS mdd, sum(fees) AS fees, sum(turnover) AS turnover
              FROM (SELECT *, equity / lag(equity) OVER w - 1 AS r, max(equity) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
                    FROM {{eq}} WINDOW w AS (PARTITION BY strategy ORDER BY t)) x GROUP BY strategy) y""",
        eq=equity,
    )
