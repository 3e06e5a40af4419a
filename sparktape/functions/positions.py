"""Vectorised position lookups on one bounded chunk of sorted rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def block_table(values: np.ndarray, fold: Callable) -> list[np.ndarray]:
    """Entry ``i`` of level ``k`` is the fold of ``values[i : i + 2**k]``, cut at the end."""
    levels, width = [values], 1
    while width < len(values):
        wider = levels[-1].copy()
        wider[:-width] = fold(levels[-1][:-width], levels[-1][width:])
        levels.append(wider)
        width *= 2
    return levels


def first_hit(levels: list[np.ndarray], start: np.ndarray, hit: Callable) -> np.ndarray:
    """First position at or after ``start`` whose value passes ``hit``, else the length.

    ``hit`` must hold for a block's folded value exactly when it holds for a value in the block.
    """
    n = len(levels[0])
    pos = start.copy()
    for k in range(len(levels) - 1, -1, -1):
        block = levels[k][np.minimum(pos, n - 1)]
        pos = np.where((pos < n) & ~hit(block), np.minimum(pos + (1 << k), n), pos)
    return pos


def span_fold(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, fold: Callable) -> np.ndarray:
    """Fold of ``values[lo : hi + 1]`` per query; every span holds at least one row."""
    length = hi - lo + 1
    level = np.frexp(length.astype(float))[1] - 1
    out = np.empty(len(lo), dtype=levels[0].dtype)
    for k in np.unique(level):
        q = level == k
        out[q] = fold(levels[k][lo[q]], levels[k][hi[q] - (1 << int(k)) + 1])
    return out
