"""Periodic runs of words, by the suffix tree's branching tandem repeats.

Inner nodes of the suffix tree are the intervals of the suffix order with a common prefix;
its symbols are the words of each document, told apart by document, so that one tree serves
a block of documents and no node spans two of them. At every node of depth D all children's
leaf lists but the largest are gone through (every leaf then is seen at most log2 n times): a
leaf i makes a branching tandem repeat with i + D, or i - D with it, if that is a leaf of the
same node and the words after the two differ. Such a repeat is rotated to the left as long as
the words D apart are equal; its rotations merge into one maximal run.

Defined cases: null and empty texts have no words and no run; a null doc_id has the decimal
form '' (its checksum is 0); equal rows give equal results; an empty table gives an empty
result; only doc_id and text are read; a text is one unit of work, whatever its length, and
several short ones share a block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, crc_of, slices
from tracewell.llm.suffix import common_prefixes, nearest_after, nearest_before, suffix_order

#: Pairs of node and leaf that are tested together.
TESTED = 1 << 18


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats: start and start + period share exactly period symbols."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    order, levels = suffix_order(symbols)
    prefix = common_prefixes(order, levels)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    same, before, after = nearest_before(prefix, True), nearest_before(prefix), nearest_after(prefix)
    # Slots between two children of a node; the node is known by its first slot.
    slots = np.flatnonzero(prefix > 0)
    if not len(slots):
        return none, none
    follows = prefix[same[slots]] == prefix[slots]
    node = np.arange(n + 1)
    node[slots[follows]] = same[slots[follows]]
    while True:
        further = node[node]
        if np.array_equal(further, node):
            break
        node = further
    ends = np.ones(n + 1, bool)
    ends[same[slots[follows]]] = False
    last = slots[ends[slots]]
    own = node[np.concatenate([slots, last])]
    low = np.concatenate([same[slots], last])
    high = np.concatenate([slots, after[last]])
    size = high - low
    # The largest child of each node stays out: the one list that is not gone through.
    rank = size * (len(size) + 1) + np.arange(len(size))
    most = np.full(n + 1, -1, np.int64)
    np.maximum.at(most, own, rank)
    small = rank != most[own]
    own, low, size = own[small], low[small], size[small]
    starts, periods = [], []
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TESTED, "right")) - 1)
        sizes = size[at:stop]
        owner = np.repeat(own[at:stop], sizes)
        leaf = order[np.repeat(low[at:stop] - (bounds[at:stop] - bounds[at]), sizes) + np.arange(bounds[stop] - bounds[at])]
        depth, left, right = prefix[owner], before[owner], after[owner]
        for first in (leaf, leaf - depth):
            second = first + depth
            other = second if first is leaf else first
            fits = np.flatnonzero((other >= 0) & (other < n))
            slot = place[other[fits]]
            fits = fits[(slot >= left[fits]) & (slot < right[fits])]
            a, d = first[fits], depth[fits]
            end = a + 2 * d
            branching = (end >= n) | (symbols[np.minimum(end, n - 1)] != symbols[a + d])
            starts.append(a[branching])
            periods.append(d[branching])
        at = stop
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return found[0], found[1]


def maximal_runs(symbols: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all maximal runs of at least max(least, times * period) symbols, in order; times is 2 or more."""
    starts, periods = branching_repeats(symbols)
    ends = starts + 2 * periods
    need = np.maximum(least, times * periods)
    # Rotate to the left, one symbol a step; the few that go on are compared in growing stretches.
    active = np.arange(len(starts))
    for _ in range(16):
        active = active[starts[active] > 0]
        at = starts[active] - 1
        active = active[symbols[at] == symbols[at + periods[active]]]
        starts[active] -= 1
        if not len(active):
            break
    seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in active[np.lexsort([periods[active], ends[active]])].tolist():
        at, d, step, end = int(starts[k]), int(periods[k]), 32, int(ends[k])
        if any(d % q == 0 and end - 2 * d >= s for s, q in seen[end]):
            need[k] = end + 1  # a power of the run that ends here
            continue
        while at:
            low = max(0, at - step)
            differs = np.flatnonzero(symbols[low:at] != symbols[low + d : at + d])
            if len(differs):
                at = low + int(differs[-1]) + 1
                break
            at, step = low, step * 2
        starts[k] = at
        seen[end].append((at, d))
    good = ends - starts >= need
    starts, ends, periods = starts[good], ends[good], periods[good]
    # Multiples of a run's period give the same stretch.
    by = np.lexsort([periods, ends, starts])
    starts, ends, periods = starts[by], ends[by], periods[by]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    return starts[new], ends[new], periods[new]


def with_repetition(words: list[bytes], checksum: int) -> list[bytes]:
    """The words, of which every tenth document's (by checksum) repeat from a place on."""
    n, g = len(words), checksum // 10
    if checksum % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The row of one document; runs are (start, end, period) in order, by word number."""
    if not runs:
        return doc_id, len(words), 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]))
    start, length, period = best[0], best[1] - best[0], best[2]
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    keep = np.ones(len(words), bool)
    for a, b, q in runs:
        keep[a + q : b] = False
    kept = b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])
    return doc_id, len(words), len(runs), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _block(ids: list, texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple]:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(x) for x in texts], np.int64)
    coded = np.fromiter((numbers[w] for x in texts for w in x), np.int64, int(sizes.sum()))
    symbols = coded + np.repeat(np.arange(len(texts)), sizes) * len(numbers)
    starts, ends, periods = maximal_runs(symbols, least, times)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(starts, bounds)
    for k, (doc_id, words) in enumerate(zip(ids, texts)):
        own = slice(cut[k], cut[k + 1])
        yield _described(doc_id, words, list(zip((starts[own] - bounds[k]).tolist(), (ends[own] - bounds[k]).tolist(), periods[own].tolist())))


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, repeated: bool = True, block_words: int = 50_000) -> DataFrame:
    """Runs of every document: their number, the one of the greatest exponent, digests of all runs and of the text without repetition.

    A run has at least least words and times its period. repeated: first write repetitions into
    every tenth document (with_repetition), as a test of the search. Nothing is shuffled; a task
    holds a block of about block_words words, or one longer text.
    """
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", block_words * 6):
                ids = part.column("doc_id").to_pylist()
                texts = [x.split() for x in bytes_of(part)]
                if repeated:
                    texts = [with_repetition(x, crc_of(d)) for d, x in zip(ids, texts)]
                rows = list(_block(ids, texts, least, times))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
