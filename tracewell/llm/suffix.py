"""Suffix order, common prefixes and their intervals for whole-number symbols, on numpy arrays."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order and, by doubling length, the rank of each start's prefix of 1, 2, 4, ... symbols.

    Ranks have one more entry, -1, for the end. Starts whose prefix is alone keep their rank and
    are not sorted again. With a depth, prefixes of at least so many symbols are told apart only.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    shown = symbols[order]
    first = np.ones(n + 1, bool)
    first[1:n] = shown[1:] != shown[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first[:n], np.arange(n), 0))
    levels, length = [rank], 1
    while depth is None or length < depth:
        at = np.flatnonzero(~(first[:n] & first[1:]))
        if not len(at):
            break
        starts = order[at]
        key = rank[starts] * (n + 2) + rank[np.minimum(starts + length, n)] + 1
        by = np.argsort(key)
        starts, key = starts[by], key[by]
        order[at] = starts
        first[at[1:]] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[starts] = at[np.maximum.accumulate(np.where(first[at], np.arange(len(at)), 0))]
        levels.append(rank)
        length *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order; the first has -1, and so has the end."""
    n = len(order)
    out = np.full(n + 1, -1, np.int64)
    if n:
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(max(n - 1, 0), np.int64)
        at = None
        for k in range(len(levels) - 1, -1, -1):
            rank, step = levels[k], 1 << k
            if k:
                at = np.flatnonzero(rank[a] == rank[b])
                a[at] += step
                b[at] += step
                length[at] += step
            else:
                length += rank[a] == rank[b]
        out[1:n] = length
    return out


def nearest_before(values: np.ndarray, or_equal: bool = False) -> np.ndarray:
    """For each entry the nearest earlier one with a smaller value (or an equal one, too); the first value must be the least of all and its entry is -1."""
    n = len(values)
    to = np.arange(-1, n - 1)
    active = np.arange(1, n)
    for _ in range(48):
        aim = values[to[active]]
        active = active[(aim > values[active]) if or_equal else (aim >= values[active])]
        if not len(active):
            return to
        to[active] = to[to[active]]
    # Long staircases: halving steps over the least values of stretches of 1, 2, 4, ... entries.
    least = [values]
    while (1 << len(least)) <= n:
        step, last = 1 << (len(least) - 1), least[-1]
        least.append(np.minimum(last[:-step], last[step:]))
    at = to[active].copy()
    own = values[active]
    for k in range(len(least) - 1, -1, -1):
        low = at - (1 << k) + 1
        fits = low >= 0
        stretch = least[k][np.maximum(low, 0)]
        skip = fits & ((stretch > own) if or_equal else (stretch >= own))
        at = np.where(skip, low - 1, at)
    to[active] = at
    return to


def nearest_after(values: np.ndarray) -> np.ndarray:
    """For each entry the nearest later one with a smaller value; the last value must be the least of all."""
    return len(values) - 1 - nearest_before(values[::-1])[::-1]
