"""State along a series that no window expresses, as maps that are composed instead of a loop over rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.plans.passes import Chunk, Request, add_passes


def reached(first: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Flags of the places met from ``first`` on when each place leads to ``following`` (the last place to itself).

    The map is composed with itself, so that each round doubles the steps: log n rounds, whatever the chain.
    """
    seen = np.zeros(len(following), bool)
    seen[first] = True
    jump = following
    while True:
        more = jump[np.flatnonzero(seen)]
        if seen[more].all():
            return seen
        seen[more] = True
        jump = jump[jump]


def next_flag(flags: np.ndarray) -> np.ndarray:
    """First flagged place at or after each place; one entry more than flags, their number where there is none."""
    n = len(flags)
    place = np.append(np.where(flags, np.arange(n), n), n)
    return np.minimum.accumulate(place[::-1])[::-1]


def _machine(c: Chunk, params: tuple, inputs: Sequence[int]) -> np.ndarray:
    (limit,) = params
    buy, sell = (c.columns[i] > 0 for i in inputs)
    n = len(buy)
    ends = np.append(c.start[1:] != c.start[:-1], True)
    end = next_flag(ends)[:-1] + 1  # after the last row of the series
    next_buy, next_sell = next_flag(buy), next_flag(sell)
    # where a position entered at each row would end, and which entry would follow
    leave = np.minimum(next_sell[1:], end)
    if limit is not None:
        leave = np.minimum(leave, c.at + max(1, limit - 1))
    after = next_buy[np.minimum(leave + 1, n)]
    following = np.append(np.where((leave + 1 < end) & (after < end), after, n), n)
    start = np.flatnonzero(c.start == c.at)
    entries = next_buy[start]
    entries = np.flatnonzero(reached(entries[entries < end[start]], following)[:n])
    change = np.zeros(n + 1)
    change[entries] = 1.0
    np.add.at(change, leave[entries], -1.0)
    return np.cumsum(change[:-1])


def state_machine(df: DataFrame, *, buy: str = "buy", sell: str = "sell", max_hold: int | None = None,
                  keys: Sequence[str] = ("symbol",), ts: str = "ts",
                  output: str = "position") -> DataFrame:
    """Flat until ``buy`` > 0; then in position until ``sell`` > 0 or ``max_hold`` bars are held.

    The exit bar counts as flat and does not re-enter. Each row knows where a position entered there would end and
    which entry would follow; composing these steps marks the entries that happen.
    """
    return add_passes(df, list(keys), ts, F.lit(1), [
        Request(output, _machine, (max_hold,), [(buy, F.col(buy)), (sell, F.col(sell))])])
