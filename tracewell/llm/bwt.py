"""Which strings of a given length repeat: interval expansion on a Burrows-Wheeler transform.

Breadth-first backward extension: intervals of suffixes with a common prefix are extended to
the left by every symbol before them; an extended interval whose right border has no value
yet fixes the common prefix there. Borders get their values in increasing order, so that the
search stops at the wanted length: borders without a value by then join suffixes that share
at least that many symbols. All steps work on arrays of intervals.
"""

from __future__ import annotations

import numpy as np

INNER = 3  # symbols that stand for a common part among bytes


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes sorted by their first depth symbols at least, whether the first symbols of a packed key change at each, and how many those are."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    packed = min(63 // bits, depth)
    padded = np.concatenate([text.astype(np.int64), np.zeros(packed, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    change = np.ones(n + 1, bool)
    change[1:n] = sorted_key[1:] != sorted_key[:-1]
    first = change.copy()
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(change[:n], np.arange(n), 0))
    width = packed
    while width < depth:
        rows = np.flatnonzero(~(change[:n] & change[1:]))
        if not len(rows):
            break
        suffix = order[rows]
        second = rank[np.minimum(suffix + width, n)] + 1
        both = rank[suffix] * (n + 1) + second
        at = np.argsort(both)
        order[rows], both = suffix[at], both[at]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = both[1:] != both[:-1]
        change[rows] = fresh | change[rows]
        rank[order[rows]] = np.maximum.accumulate(np.where(fresh, rows, 0))
        width *= 2
    return order, first, packed


def long_borders(text: np.ndarray, order: np.ndarray, first: np.ndarray, packed: int, length: int) -> np.ndarray:
    """For each sorted suffix, whether it shares fewer than length symbols with the one before it.

    text: symbols from 1 on, with 0 between strings. Shared stretches over a 0 may count.
    first: whether it shares fewer than packed symbols.
    """
    n, symbols = len(text), int(text.max()) + 1
    bwt = np.where(order > 0, text[np.maximum(order - 1, 0)], 0).astype(np.int64)
    by_symbol = np.argsort(bwt.astype(np.uint16) if symbols <= 1 << 16 else bwt, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one longer stands
    step[by_symbol] = np.arange(n)
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    border = first.copy()
    border[n] = True
    left = np.flatnonzero(border[:n])
    right = np.append(left[1:], n) - 1
    for _ in range(packed, length):
        if not len(left):
            break
        sizes = right - left + 1
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(left - (ends - sizes), sizes)
        symbol = bwt[rows]
        lows, highs = np.repeat(left, sizes), np.repeat(right, sizes)
        last = (after[rows] > highs) & (symbol > 0)
        new_right = step[rows[last]]
        fresh = ~border[new_right + 1]
        if not fresh.any():
            break
        begin = (before[rows] < lows) & (symbol > 0)
        key = np.repeat(np.arange(len(left)) * symbols, sizes) + symbol
        opened = rows[begin][np.argsort(key[begin])]
        closed = np.argsort(key[last])
        new_left = np.empty(len(new_right), np.int64)
        new_left[closed] = step[opened]
        left, right = new_left[fresh], new_right[fresh]
        # One right border may close intervals of one string only once.
        right, at = np.unique(right, return_index=True)
        left = left[at]
        border[right + 1] = True
    return border


def _repeated(strings: list[bytes], owners: list[tuple[int, int]], several: list[bool], length: int, inner: list[tuple[int, int]] | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a repeated string starts at each symbol of the strings, with one more symbol after each string; and where each string starts there."""
    sizes = np.array([len(x) for x in strings], np.int64) // width
    n = int(sizes.sum()) + len(strings)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(n, np.int32)
    filled = np.ones(n, bool)
    filled[starts + sizes] = False
    raw = np.frombuffer(b"".join(strings), np.uint8)
    if width > 1:
        _, raw = np.unique(sum(raw[k::width].astype(np.int32) << 8 * k for k in range(width)), return_inverse=True)
    text[filled] = raw.astype(np.int32) + 1
    if inner is not None:
        at = starts + np.array([a for a, _ in inner], np.int64)
        number = np.array([k for _, k in inner], np.int64)
        if width > 1:
            text[at] = int(text.max()) + 1 + number - number.min()
        else:
            for k in range(INNER):
                text[at + k] = 257 + number // 255**k % 255
    order, first, packed = suffix_order(text, length)
    border = long_borders(text, order, first, packed, length)
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(n) - starts[string]
    whole = (sizes[string] - offset) >= length
    place = np.array([a for a, _ in owners], np.int64)[string] * (1 << 42) + np.array([b for _, b in owners], np.int64)[string] + offset
    runs = np.flatnonzero(border[:n])
    spot = place[order]
    multiple = np.array(several)[string][order]
    hit = (np.minimum.reduceat(spot, runs) != np.maximum.reduceat(spot, runs)) | np.logical_or.reduceat(multiple, runs)
    rows = np.repeat(hit, np.diff(np.append(runs, n))) & whole[order]
    found = np.zeros(n, bool)
    found[order[rows]] = True
    return found, starts


def repeated_starts(strings: list[bytes], owners: list[tuple[int, int]], several: list[bool], length: int, inner: list[tuple[int, int]] | None = None, width: int = 1) -> list[np.ndarray]:
    """For each string, the offsets at which a repeated string of the given length starts.

    owners: a text's number and the string's place in it; the same place of the same text,
    seen through two strings, is no repeat. several: the whole string is known to stand
    elsewhere too. inner: (offset, number) of a long common part of each string, for which
    placeholder bytes stand at the offset (INNER; of wider symbols, one symbol); parts of
    other numbers are other parts. width: bytes of a symbol; offsets and lengths are in symbols.
    """
    found, starts = _repeated(strings, owners, several, length, inner, width)
    return [np.flatnonzero(x) for x in np.split(found, starts[1:])]


def repeated_ranges(strings: list[bytes], owners: list[tuple[int, int]], several: list[bool], length: int, inner: list[tuple[int, int]] | None = None, width: int = 1) -> list[tuple[int, int, int]]:
    """(string, first, last) of the offsets of repeated_starts, for the strings that have any."""
    found, starts = _repeated(strings, owners, several, length, inner, width)
    rows = np.flatnonzero(found)
    if not len(rows):
        return []
    string = np.searchsorted(starts, rows, "right") - 1
    change = string[1:] != string[:-1]
    first, last = rows[np.append(True, change)], rows[np.append(change, True)]
    string = string[np.append(True, change)]
    return list(zip(string.tolist(), (first - starts[string]).tolist(), (last - starts[string]).tolist()))
