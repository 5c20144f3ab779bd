"""Analytics of a trade log ``(account, symbol, created_at, seq, side, volume, price, fee)``.

``side`` is 1 for a buy and 2 for a sell; ``seq`` orders trades of the same time.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.fold import next_flag, reached
from quantloom.plans.passes import Chunk, add_carried
from quantloom.plans.scans import affine_scan

KEYS = ("account", "symbol")


#: Volumes are counted in units of so many to one, so that a position is flat exactly when they cancel.
UNITS = 10**8


class Held(NamedTuple):
    """What a series' rows leave behind: the open position (if any) and the place and price of its opening."""

    volume: float
    cost: float
    open_fee: float
    open: bool
    at: float
    price: float


_NOTHING = Held(0.0, 0.0, 0.0, False, np.nan, np.nan)


def _trips(c: Chunk, carry: Held | None) -> tuple[dict[str, np.ndarray], Held]:
    """What each row finds: volume, cost and opening fee of the open position, and its opening's price and time.

    A position runs from a buy while flat to the row where the volumes cancel; the buy after that opens the next.
    Chains of positions are composed maps, costs an affine scan: buys add, sells keep their share. A position that
    earlier rows left open stands as one more buy before these. Only series that were sold beyond their volume are
    followed row by row.
    """
    side, q, price, fee, time = c.columns
    q, start, at = np.abs(q), c.start, c.at
    carried = carry is not None
    if carried:  # a row before the others: a buy of what is held, or nothing
        side, q, price, fee, time = (np.append(x, column) for x, column in zip(
            (1.0 if carry.open else 0.0, max(carry.volume, 0.0), carry.price, 0.0, carry.at), (side, q, price, fee, time)))
        start, at = np.append(0, np.where(start > 0, start + 1, 0)), np.arange(len(q))
    n = len(side)
    buy, sell = side == 1, side == 2
    signed = np.where(buy, 1, np.where(sell, -1, 0)) * np.rint(q * UNITS).astype(np.int64)
    total = np.cumsum(signed)
    ends = np.append(start[1:] != start[:-1], True)
    end = next_flag(ends)[:-1] + 1
    # the first later row at which the total is what it was before each row
    _, code = np.unique(np.append(total, 0), return_inverse=True)
    code, before = code[:-1], np.append(code[-1], code[:-2])
    width = n + 1
    keys = np.sort(code * width + at)
    place = np.searchsorted(keys, before * width + at, side="right")
    found = keys[np.minimum(place, n - 1)]
    flat = np.where((place < n) & (found // width == before), found % width, n)
    flat = np.where(flat < end, flat, n)
    next_buy = next_flag(buy)
    after = next_buy[np.minimum(flat + 1, n)]
    following = np.append(np.where((flat < n) & (after < end), after, n), n)
    starts = np.flatnonzero(start == at)
    first = next_buy[starts]
    opens = np.flatnonzero(reached(first[first < end[starts]], following)[:n])

    opened = np.full(n, -1)
    opened[opens] = opens
    opened = np.maximum.accumulate(opened)
    inside = (opened >= start) & (at <= flat[opened])
    opened = np.where(inside, opened, -1)
    base = total[opened] - signed[opened]
    volume = np.where(inside, (total - base) / UNITS, 0.0)
    earlier = inside & (opened != at)  # rows that find the position open

    def found_before(x: np.ndarray) -> np.ndarray:
        return np.where(earlier, np.append(0.0, x[:-1]), 0.0)
    held = found_before(volume)
    left = np.where(sell & earlier, np.divide(volume, held, out=np.zeros(n), where=held != 0), np.where(earlier, 1.0, 0.0))
    paid, paid_fee = np.where(buy & inside, q * price + fee, 0.0), np.where(at == opened, fee, 0.0)
    if carried:
        paid[0], paid_fee[0] = carry.cost, carry.open_fee
    (cost, _), (open_fee, _) = affine_scan(left, paid, start), affine_scan(left, paid_fee, start)
    out = {"_held": held, "_cost": found_before(cost), "open_fee": found_before(open_fee),
           "open_price": np.where(earlier, price[opened], np.nan), "_open": np.where(earlier, time[opened], np.nan)}
    open_now = bool(inside[-1] and volume[-1] != 0)
    state = Held(float(volume[-1]), float(cost[-1]), float(open_fee[-1]), open_now, *(
        (float(time[opened[-1]]), float(price[opened[-1]])) if open_now else (np.nan, np.nan)))
    beyond = np.unique(start[inside & (volume < 0)]).tolist()
    if carried and carry.open and carry.volume <= 0:
        beyond = sorted({0, *beyond})
    for s in beyond:
        rows = slice(s + (carried and s == 0), int(end[s]))
        reached_state = _follow(out, rows, carry if carried and s == 0 else _NOTHING, side, q, price, fee, time)
        state = reached_state if end[s] == n else state
    return {k: v[1:] for k, v in out.items()} if carried else out, state


def _follow(out: dict[str, np.ndarray], rows: slice, held: Held, side, q, price, fee, time) -> Held:
    """The same for one series, row by row: volume may pass zero and be bought back."""
    volume, cost, open_fee, opened, at, paid = held
    found = []
    for s, amount, p, f, t in zip(*(x[rows].tolist() for x in (side, q, price, fee, time))):
        found.append((volume, cost, open_fee, paid if opened else np.nan, at if opened else np.nan))
        if s == 1:
            volume, cost = round((volume + amount) * UNITS) / UNITS, cost + amount * p + f
            if not opened:
                opened, at, paid, open_fee = True, t, p, open_fee + f
        elif s == 2 and volume != 0:
            share = amount / volume
            volume, cost, open_fee = round((volume - amount) * UNITS) / UNITS, cost - share * cost, open_fee - share * open_fee
            if volume == 0:
                opened, open_fee = False, 0.0
    for name, values in zip(("_held", "_cost", "open_fee", "open_price", "_open"), zip(*found)):
        out[name][rows] = values
    return Held(volume, cost, open_fee, opened, at, paid)


def round_trips(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per sell with its profit against the average cost of the open position.

    Buys add volume and cost (fee included); a sell takes its share of cost and opening fee. Sells
    without a position are skipped; a flat position starts anew. Volumes count in units of 1e-8.
    Fills stream through their task, which hands the open position on: its memory does not grow with the series.
    """
    keys = list(keys)
    x = trades.filter((F.col("volume") != 0) & F.col("price").isNotNull() & ~F.isnan("price"))
    x = x.select(*keys, F.col("created_at").cast("timestamp").alias("created_at"), "seq", F.col("side").cast("int").alias("side"), F.abs(F.col("volume").cast("double")).alias("volume"),
                 F.col("price").cast("double").alias("price"), F.col("fee").cast("double").alias("fee"))
    inputs = [*map(F.col, ("side", "volume", "price", "fee")), F.unix_micros("created_at")]
    x = add_carried(x.withColumn("_time", F.struct("created_at", "seq")), keys, "_time", inputs, ("_held", "_cost", "open_fee", "open_price", "_open"), _trips)
    share = F.col("volume") / F.col("_held")
    part, part_fee = share * F.col("_cost"), share * F.col("open_fee")
    return x.filter((F.col("side") == 2) & (F.col("_held") != 0)).select(
        *keys, F.timestamp_micros(F.col("_open").cast("long")).alias("open_time"), F.col("created_at").alias("close_time"),
        "open_price", F.col("price").alias("close_price"), "volume", part_fee.alias("open_fee"), F.col("fee").alias("close_fee"),
        (F.col("volume") * F.col("price") - part - F.col("fee")).alias("profit"))


def trip_stats(trips: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Win rate, mean profit and loss (amount and share of the opening value), profit/loss ratio,
    mean holding days, Kelly and half Kelly."""
    p = F.col("profit")
    value = F.abs("volume") * F.col("open_price")
    pct = F.when(value != 0, p / value)
    days = F.floor((F.unix_timestamp("close_time") - F.unix_timestamp("open_time")) / 86400)
    a = trips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trips"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(F.when(p > 0, p)).alias("avg_profit"), F.avg(F.when(p < 0, p)).alias("avg_loss"),
        F.avg(F.when(p > 0, pct)).alias("avg_profit_pct"), F.avg(F.when(p < 0, pct)).alias("avg_loss_pct"),
        F.avg(days).alias("holding_days"))
    ratio = F.when(F.col("avg_loss") != 0, F.abs(F.col("avg_profit") / F.col("avg_loss")))
    a = a.withColumn("profit_loss_ratio", ratio)
    kelly = F.when(F.col("profit_loss_ratio") > 0,
                   F.col("win_rate") - (1 - F.col("win_rate")) / F.col("profit_loss_ratio"))
    return a.withColumns({"kelly": kelly, "half_kelly": kelly / 2})


def top_trips(trips: DataFrame, n: int = 10, winners: bool = True) -> DataFrame:
    """The n most profitable (or most losing) round trips; a report, sorted by profit."""
    p = F.col("profit")
    x = trips.filter(p > 0 if winners else p < 0)
    return x.orderBy(p.desc() if winners else p.asc(), "symbol", "close_time").limit(n)


def in_range(trades: DataFrame, start, end) -> DataFrame:
    return trades.filter(F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def positions(trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Signed volume held after each fill."""
    signed = F.when(F.col("side") == 1, F.abs("volume")).otherwise(-F.abs("volume"))
    w = W.partitionBy(*keys).orderBy("created_at", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return trades.withColumn("held", F.sum(signed).over(w))


def trade_fee(price: Column, volume: Column, side: Column, *, commission: float, stamp: float, minimum: float) -> Column:
    """max(round(value * commission), minimum), plus the stamp tax on sells; half-even cents."""
    value = price * F.abs(volume)
    tax = F.when(side == 2, F.bround(value * stamp, 2)).otherwise(0.0)
    return F.greatest(F.bround(value * commission, 2), F.lit(float(minimum))) + tax


def account_as_of(snapshots: DataFrame, at, by: Sequence[str] = ("account",)) -> DataFrame:
    """Last snapshot per account at or before a time."""
    fields = [c for c in snapshots.columns if c not in by]
    return (snapshots.filter(F.col("created_at") <= F.lit(at).cast("timestamp")).groupBy(*by)
            .agg(F.max_by(F.struct(*fields), "created_at").alias("_s")).select(*by, "_s.*"))
