"""Recurrences ``y = a*y + b`` as prefix scans: a row is the map ``y -> a*y + b``, and maps are composed.

Composing the maps of 1, 2, 4, ... rows gives every row the map of all rows of its series up to it, in log n vector
operations, whatever the shares ``a`` are: nothing is cut off and nothing is divided.
"""

from __future__ import annotations

import numpy as np


def affine_scan(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``y`` of each row, from 0 before its series' first row ``start``, and the product of ``a`` up to it.

    A missing ``a`` or ``b`` (NaN) makes itself and every later row of its series missing.
    """
    at = np.arange(len(a))
    gap = np.maximum.accumulate(np.where(np.isnan(a) | np.isnan(b), at, -1)) >= start
    a, b = np.where(np.isnan(a), 0.0, a), np.where(np.isnan(b), 0.0, b)
    longest = int((at - start).max(initial=0)) + 1
    step = 1
    while step < longest:
        here = at[at - step >= start]
        here = here[a[here] != 0]  # a row that forgets what was before it is done
        if not len(here):
            break
        before = here - step
        b[here] += a[here] * b[before]
        a[here] *= a[before]
        step *= 2
    return np.where(gap, np.nan, b), np.where(gap, np.nan, a)


def recurrence(x: np.ndarray, row: np.ndarray, start: np.ndarray, a: float, b: float, seed_rows: int, skip: int,
               seed: str) -> np.ndarray:
    """``y = a*y + b*x`` from the row after the first ``skip + seed_rows`` on, seeded there with the mean (or sum) of the
    last ``seed_rows``; a missing value after row ``skip`` makes all later ones missing."""
    first = skip + seed_rows
    put = np.where(row > first, b * x, 0.0)
    at = np.flatnonzero(row == first)
    if len(at):
        seeds = x[at[:, None] - np.arange(seed_rows)]
        put[at] = seeds.mean(axis=1) if seed == "mean" else seeds.sum(axis=1)
    y, _ = affine_scan(np.where(row > first, a, 0.0), put, start)
    return np.where(row >= first, y, np.nan)
