"""Medians, quantiles and ranks of windows and histories, all from one wavelet of a column.

Values are replaced by their places in sorted order, and these are split bit by bit, the highest first, keeping the
order of time (a wavelet matrix). A walk down its levels then finds the k-th smallest value of any stretch of rows, or
how many values of it are below a bound: one step a bit, whatever the stretch. So every window length, quantile and rank
of a column shares one structure of n log n bits, and no row holds its history.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Order statistics of stretches ``lo .. hi`` of a sequence without missing values; all arguments are arrays."""

    def __init__(self, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        places = np.empty(len(values), np.int64)
        places[order] = np.arange(len(values))
        self.levels: list[tuple[int, np.ndarray]] = []  # bit, number of zero bits before each place
        for bit in reversed(range(max(len(values) - 1, 0).bit_length())):
            zero = places >> bit & 1 == 0
            before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before))
            places = np.concatenate([places[zero], places[~zero]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The values with ``k`` (from 0) smaller ones; only for ``k < hi - lo``."""
        found = np.zeros(len(lo), np.int64)
        for bit, before in self.levels:
            a, b = before[lo], before[hi]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            lo, hi = np.where(up, before[-1] + lo - a, a), np.where(up, before[-1] + hi - b, b)
            found += up.astype(np.int64) << bit
        return self.sorted[found]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values are smaller than ``bound``; ``side="right"``: or equal to it."""
        place = np.searchsorted(self.sorted, bound, side=side)
        count = np.where(place >= len(self.sorted), hi - lo, 0)
        place = np.where(place >= len(self.sorted), 0, place)
        for bit, before in self.levels:
            a, b = before[lo], before[hi]
            up = place >> bit & 1 == 1
            count += np.where(up, b - a, 0)
            lo, hi = np.where(up, before[-1] + lo - a, a), np.where(up, before[-1] + hi - b, b)
        return count


class Stretches:
    """One stretch for each row: from row ``lo`` to this one, values that are missing (NaN) left out."""

    def __init__(self, value: np.ndarray, wavelet: Wavelet, before: np.ndarray, lo: np.ndarray) -> None:
        self.value, self.wavelet = value, wavelet
        self.lo, self.hi = before[lo], before[1:]
        self.n = self.hi - self.lo

    def nearest(self, p: float) -> np.ndarray:
        """The value at place ``ceil(p n)`` of the sorted stretch."""
        return self._kth(np.maximum(np.ceil(p * self.n).astype(np.int64), 1) - 1)

    def linear(self, p: float) -> np.ndarray:
        at = (np.maximum(self.n, 1) - 1) * p
        low, high = np.floor(at), np.ceil(at)
        a, b = self._kth(low.astype(np.int64)), self._kth(high.astype(np.int64))
        return np.where(low == high, a, (high - at) * a + (at - low) * b)

    def below(self, side: str = "left") -> np.ndarray:
        """How many values are smaller than the row's own; ``side="right"``: or equal."""
        there = ~np.isnan(self.value)
        out = np.full(len(self.value), np.nan)
        out[there] = self.wavelet.below(self.lo[there], self.hi[there], self.value[there], side)
        return out

    def _kth(self, k: np.ndarray) -> np.ndarray:
        some = self.n > 0
        out = np.full(len(some), np.nan)
        out[some] = self.wavelet.kth(self.lo[some], self.hi[some], np.minimum(k, self.n - 1)[some])
        return out
