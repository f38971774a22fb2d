"""Labels and the walk-forward backtest.

Signals of all bars are independent and computed first, in parallel; only the
fills of one symbol are a sequence, folded over that symbol's bars.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.operators import walk
from volumetra.sources.bars import indexed

# Bars in a year by interval.
PERIODS = {"1d": 252, "1wk": 52, "1mo": 12, "1h": 252 * 7, "60m": 252 * 7, "30m": 252 * 13, "15m": 252 * 26, "5m": 252 * 78, "2m": 252 * 195, "1m": 252 * 390}


def triple_barrier(bars: DataFrame, events: DataFrame, horizon: int = 20, profit: float = 2.0, stop: float = 2.0) -> DataFrame:
    """First touch of each event's barriers over the next `horizon` bars.

    bars: symbol, idx, high, low, close; events: symbol, idx, side, vol (a share of the price; not above zero counts as 0.01).
    The join is on (symbol, idx) after an event is exploded to the bars it sees: an equi-join, not a range join.
    Returns events with outcome, ret, win, exit_idx. A bar that touches both barriers counts as stopped.
    """
    e = events.withColumn("_v", F.when(F.col("vol") > 0, F.col("vol")).otherwise(0.01))
    entry = bars.select("symbol", "idx", F.col("close").alias("_entry"))
    e = e.join(entry, ["symbol", "idx"])
    seen = e.select("symbol", "idx", "side", "_v", "_entry", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + horizon)).alias("_at"))
    b = bars.select("symbol", F.col("idx").alias("_at"), "high", "low", "close")
    j = seen.join(b, ["symbol", "_at"])
    long = F.col("side") == 1
    up = F.when(long, F.col("high") >= F.col("_entry") * (1 + profit * F.col("_v"))).otherwise(F.col("low") <= F.col("_entry") * (1 - profit * F.col("_v")))
    down = F.when(long, F.col("low") <= F.col("_entry") * (1 - stop * F.col("_v"))).otherwise(F.col("high") >= F.col("_entry") * (1 + stop * F.col("_v")))
    hit = F.when(down, -1).when(up, 1)
    j = j.withColumn("_hit", hit)
    g = j.groupBy("symbol", "idx", "side").agg(F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_at"))).alias("_hit"), F.min(F.when(F.col("_hit").isNotNull(), F.col("_at"))).alias("_when"), F.max("_at").alias("_end"), F.max_by("close", "_at").alias("_last"))
    out = e.join(g, ["symbol", "idx", "side"], "left")
    h = F.coalesce("_hit", F.lit(0))
    s = F.col("side")
    price = F.when(h == 1, F.col("_entry") * (1 + s * profit * F.col("_v"))).when(h == -1, F.col("_entry") * (1 - s * stop * F.col("_v"))).otherwise(F.coalesce("_last", "_entry"))
    ret = s * (price - F.col("_entry")) / F.col("_entry")
    out = out.withColumns({"outcome": h, "ret": ret, "win": (ret > 0).cast("int"), "exit_idx": F.coalesce("_when", "_end", "idx")})
    return out.drop("_v", "_entry", "_hit", "_when", "_end", "_last")


#: Equity that sizes any trade: plans are made before the cash is known.
UNBOUNDED = 1e15
TRADE = "symbol string, side string, entry_idx int, exit_idx int, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, size double, stop double, target double, pnl double, return_pct double, r_multiple double, exit_reason string, bars_held int"
CURVE = "symbol string, idx int, ts timestamp, equity double"


def fill(price: float, side: int, slippage: float, half_spread: float) -> float:
    return price * (1 + side * (slippage + half_spread) / 1e4)


class Fills:
    """The fill machine of one symbol: a few numbers of state, one bar a step, in a batch or a stream.

    A signal (side, stop, target, risk of a unit) is taken at a close if the cash of that moment sizes one unit at that
    risk (none given: it counts). It fills at the next open, unless that open is beyond its stop. Size risks `risk` of the
    cash and costs no more than the cash. After the entry bar an open beyond a level fills at the open; the stop is taken
    before the target.
    """

    def __init__(self, cash: float = 10_000.0, slippage: float = 5.0, spread: float = 0.0, commission: float = 0.0, per_share: float = 0.0, risk: float = 0.01, max_hold: int | None = None):
        self.cash, self.slippage, self.half, self.commission, self.per_share, self.risk, self.max_hold = cash, slippage, spread / 2, commission, per_share, risk, max_hold
        #: (side, entry, size, stop, target, bar, time) and (side, stop, target)
        self.pos = self.pending = None

    def pay(self, price: float, size: float) -> float:
        return price * size * self.commission / 1e4 + self.per_share * size

    def close(self, i: int, ts, price: float, why: str) -> tuple:
        side, entry, size, stop, target, since, since_ts = self.pos
        pnl = side * (price - entry) * size - self.pay(entry, size) - self.pay(price, size)
        self.cash += pnl
        at_risk = abs(entry - stop) * size
        self.pos = None
        return ("long" if side > 0 else "short", since, i, since_ts, ts, entry, price, size, stop, target, pnl, pnl / (entry * size) * 100, pnl / at_risk if at_risk else 0.0, why, i - since)

    def enter(self, i: int, ts, o: float) -> None:
        side, stop, target = self.pending
        self.pending = None
        entry = fill(o, side, self.slippage, self.half)
        if side * (entry - stop) > 0:
            size = min(math.floor(self.cash * self.risk / abs(entry - stop)), math.floor(self.cash / entry))
            if size > 0:
                self.pos = (side, entry, float(size), stop, target, i, ts)

    def leave(self, i: int, o: float, h: float, l: float, c: float) -> tuple[float, str] | None:
        side, _, _, stop, target, since, _ = self.pos
        worst, best = (l, h) if side > 0 else (h, l)
        if i > since and side * (o - stop) <= 0:
            return o, "stop"
        if i > since and side * (o - target) >= 0:
            return o, "target"
        if side * (worst - stop) <= 0:
            return stop, "stop"
        if side * (best - target) >= 0:
            return target, "target"
        return (c, "time") if self.max_hold is not None and i - since >= self.max_hold else None

    def step(self, i: int, ts, o: float, h: float, l: float, c: float, signal: tuple | None) -> tuple | None:
        """Takes a bar; returns the trade that it closes, if any."""
        trade = None
        if self.pos is None and self.pending is not None:
            self.enter(i, ts, o)
        if self.pos is not None and (out := self.leave(i, o, h, l, c)):
            trade = self.close(i, ts, fill(out[0], -self.pos[0], self.slippage, self.half), out[1])
        if self.pos is None and self.pending is None and signal is not None:
            side, stop, target, *unit = signal
            if not unit or math.floor(self.cash * self.risk / unit[0]) > 0:
                self.pending = side, stop, target
        return trade

    def equity(self, c: float) -> float:
        return self.cash + (self.pos[0] * (c - self.pos[1]) * self.pos[2] if self.pos else 0.0)


def fold(bars: pd.DataFrame, signals: dict[int, tuple], lookback: int = 120, stride: int = 1, **settings):
    """Trades and equity of one symbol: `Fills` over all its bars, what is open at the end closed at the last close.

    signals: bar index to what was decided at that bar's close.
    """
    o, h, l, c, ts = (bars[x].to_numpy() for x in ("open", "high", "low", "close", "ts"))
    machine = Fills(**settings)
    trades, curve = [], []
    for i in range(lookback - 1, len(c)):
        trade = machine.step(i, ts[i], o[i], h[i], l[i], c[i], signals.get(i) if (i - lookback + 1) % stride == 0 else None)
        if trade:
            trades.append(trade)
        curve.append((i, ts[i], machine.equity(c[i])))
    if machine.pos is not None:
        trades.append(machine.close(len(c) - 1, ts[-1], float(c[-1]), "end"))
        curve[-1] = (*curve[-1][:2], machine.cash)
    return trades, curve


#: Equity that sizes any trade: plans are made before the cash is known.
UNBOUNDED = 1e15
TRADE = "symbol string, side string, entry_idx int, exit_idx int, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, size double, stop double, target double, pnl double, return_pct double, r_multiple double, exit_reason string, bars_held int"
CURVE = "symbol string, idx int, ts timestamp, equity double"


def fill(price: float, side: int, slippage: float, half_spread: float) -> float:
    return price * (1 + side * (slippage + half_spread) / 1e4)


def fold(bars: pd.DataFrame, signals: dict[int, tuple], lookback: int = 120, cash: float = 10_000.0, slippage: float = 5.0, spread: float = 0.0, commission: float = 0.0, per_share: float = 0.0, risk: float = 0.01, max_hold: int | None = None, stride: int = 1):
    """Trades and equity of one symbol. signals: bar index to (side, stop, target, risk of a unit) decided at that bar's close.

    A signal counts if the cash of that moment sizes one unit at that risk (none given: it counts). It fills at the next open, unless that open is beyond its stop. Size risks `risk` of the cash and costs no more
    than the cash. After the entry bar an open beyond a level fills at the open; the stop is taken before the target.
    """
    o, h, l, c, ts = (bars[x].to_numpy() for x in ("open", "high", "low", "close", "ts"))
    half = spread / 2
    pay = lambda p, n: p * n * commission / 1e4 + per_share * n
    pos = pending = None
    trades, curve = [], []

    def close(at: int, price: float, why: str):
        nonlocal cash, pos
        side, entry, size, stop, target, since = pos
        pnl = side * (price - entry) * size - pay(entry, size) - pay(price, size)
        cash += pnl
        at_risk = abs(entry - stop) * size
        trades.append(("long" if side > 0 else "short", since, at, ts[since], ts[at], entry, price, size, stop, target, pnl, pnl / (entry * size) * 100, pnl / at_risk if at_risk else 0.0, why, at - since))
        pos = None

    for i in range(lookback - 1, len(c)):
        if pos is None and pending is not None:
            side, stop, target = pending
            pending = None
            entry = fill(o[i], side, slippage, half)
            if side * (entry - stop) > 0:
                size = min(math.floor(cash * risk / abs(entry - stop)), math.floor(cash / entry))
                if size > 0:
                    pos = (side, entry, float(size), stop, target, i)
        if pos is not None:
            side, _, _, stop, target, since = pos
            worst, best = (l[i], h[i]) if side > 0 else (h[i], l[i])
            out = None
            if i > since and side * (o[i] - stop) <= 0:
                out = o[i], "stop"
            elif i > since and side * (o[i] - target) >= 0:
                out = o[i], "target"
            elif side * (worst - stop) <= 0:
                out = stop, "stop"
            elif side * (best - target) >= 0:
                out = target, "target"
            elif max_hold is not None and i - since >= max_hold:
                out = c[i], "time"
            if out:
                close(i, fill(out[0], -side, slippage, half), out[1])
        if pos is None and pending is None and (i - lookback + 1) % stride == 0 and i in signals:
            side, stop, target, *unit = signals[i]
            if not unit or math.floor(cash * risk / unit[0]) > 0:
                pending = side, stop, target
        curve.append((i, ts[i], cash + (pos[0] * (c[i] - pos[1]) * pos[2] if pos else 0.0)))
    if pos is not None:
        close(len(c) - 1, float(c[-1]), "end")
        curve[-1] = (*curve[-1][:2], cash)
    return trades, curve


def candidate_signals(bars: DataFrame, lookback: int = 120, stride: int = 1, style: str = "reversion", mode: str = "auto") -> DataFrame:
    """symbol, idx, side, stop, target, risk_per_unit of every bar whose window gives a trade; the size is left to the cash of the day."""
    s = walk.scores(walk.chunks(bars, lookback, stride), mode, style, UNBOUNDED).filter("action <> 'no_trade'")
    return s.select("symbol", "idx", F.when(F.col("action") == "long", 1).otherwise(-1).alias("side"), "stop", F.get("targets", F.lit(0)).alias("target"), "risk_per_unit")


def backtest(bars: DataFrame, signals: DataFrame, what: str = "trades", **settings) -> DataFrame:
    """Trades, or the equity curve, of every symbol."""
    b = indexed(bars).select("symbol", "ts", "open", "high", "low", "close", F.col("idx").cast("int").alias("idx"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("idx")
        own = {int(r.idx): (int(r.side), float(r.stop), float(r.target), *([float(r.risk_per_unit)] if hasattr(r, "risk_per_unit") else [])) for r in right.itertuples()}
        trades, curve = fold(left, own, **settings)
        rows = [(key[0], *t) for t in (trades if what == "trades" else curve)]
        names = [x.split()[0] for x in (TRADE if what == "trades" else CURVE).split(", ")]
        return pd.DataFrame(rows, columns=names)

    return b.groupBy("symbol").cogroup(signals.groupBy("symbol")).applyInPandas(run, TRADE if what == "trades" else CURVE)


def trade_stats(trades: DataFrame, group: list[str]) -> DataFrame:
    """One aggregate over the blotter; profits without losses give an infinite factor."""
    p = F.col("pnl")
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), -F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0))
    factor = F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)
    return trades.groupBy(*group).agg(F.count("*").alias("n_trades"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"), factor.alias("profit_factor"), F.avg("pnl").alias("expectancy"), F.avg("r_multiple").alias("avg_r"), F.sum("pnl").alias("pnl"))


def curve_stats(curve: DataFrame, group: list[str], interval: str = "1d") -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy(*group).orderBy("idx")
    c = curve.withColumn("_dd", F.col("equity") / F.max("equity").over(w) - 1).withColumn("_r", F.col("equity") / F.lag("equity").over(w) - 1)
    sd = F.stddev_samp("_r")
    sharpe = F.when(sd > 0, F.avg("_r") / F.nullif(sd, F.lit(0.0)) * math.sqrt(PERIODS.get(interval, 252))).otherwise(0.0)
    return c.groupBy(*group).agg(F.count("*").alias("n_bars"), F.max_by("equity", "idx").alias("final_equity"), (F.min("_dd") * 100).alias("max_drawdown_pct"), sharpe.alias("sharpe"))


def cost(price: Column, side: int, slippage: float = 5.0, spread: float = 0.0) -> Column:
    return price * (1 + side * (slippage + spread / 2) / 1e4)
