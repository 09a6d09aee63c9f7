"""Substring dedup by relative Lempel-Ziv parsing: words of passages that an earlier document holds go.

A reference block is made of all stretches of text round some anchors, so that a document is
factored against every block that can hold anything of its. Anchors are the grams of four
words whose hash is the least in some window of min_words words: equal windows have the same
anchors at the same places. Anchors of one document only are dropped; round each of the
others a stretch is cut that holds every window with that anchor, and the stretches of an
anchor meet in one block. There every stretch is parsed greedily, relative to the stretches of
documents with a smaller doc_id: a factor is the longest piece that stands there. The longest
piece at each place comes from the block's suffix order, between the nearest suffixes of
earlier documents on both sides. Factors of min_words words or more are repeats; windows that
reach over a factor's end are checked there, at the boundary.

An anchor of more than hot_count places is lengthened to the whole windows round it: their
parse is equality, so the least doc_id of each is aggregated before anything is shuffled and
joined back. Equal texts are one text; all but those with its least doc_id go whole, if they are long
enough.

Defined cases: null and empty texts have no words; texts under min_words words keep all; a
null doc_id counts as greater than any other; of rows with one doc_id none is earlier than another;
an empty table gives an empty result; only doc_id and text are read; a text is never cut.
Words are compared by 64-bit hashes, windows round hot anchors by 128-bit ones.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, key_of, slices, text_key, written
from tracewell.llm.substrings import POWERS, SPACE, VALUES
from tracewell.llm.suffix import common_prefixes, nearest_before, suffix_order

GRAM = 4
LAST = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: their hashes, and their places in raw, all texts one after another."""

    def __init__(self, texts: list[bytes], chunk: int = 1 << 17):
        self.raw = b" ".join(texts) + b" "
        raw = np.frombuffer(self.raw, np.uint8)
        gap = SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edges = np.concatenate([[0], edge]) if not gap[0] else edge
        self.starts, self.stops = edges[::2], edges[1::2]
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        self.counts = np.diff(np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)])))
        self.hashes = np.empty(len(self.starts), np.uint64)
        for k in range(0, len(self.starts), chunk):
            own = slice(k, k + chunk)
            starts = self.starts[own]
            first, last = starts[0], self.stops[own][-1]
            place = np.arange(first, last) - np.repeat(starts, np.diff(np.append(starts, last)))
            terms = VALUES[raw[first:last]] * POWERS[place & 4095]
            terms[gap[first:last]] = 0
            self.hashes[own] = np.add.reduceat(terms, starts - first)
        self.hashes = _mixed(self.hashes)


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place among all words, hash) of all anchors, in order of place."""
    gram = min(GRAM, window)
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    g = words.hashes[: n - gram + 1].copy()
    for j in range(1, gram):
        g *= MIX
        g += words.hashes[j : j + len(g)]
    g = _mixed(g)
    span = window - gram + 1
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    # 0 for windows that reach over a text's end; then an anchor equals the least of some window that holds it.
    least = g[: n - window + 1].copy()
    for j in range(1, span):
        np.minimum(least, g[j : j + len(least)], out=least)
    least *= owner[: n - window + 1] == owner[window - 1 :]
    most = np.zeros(len(g), np.uint64)
    for j in range(span):
        part = most[j : j + len(least)]
        np.maximum(part, least, out=part)
    at = np.flatnonzero((g == most) & (most > 0))
    return owner[at], at, g[at].view(np.int64)


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc_id, text_hash) of every anchor; equal rows of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {(d, k): x for d, k, x in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), bytes_of(part))}
                ids, keys = (np.array(x, np.int64) for x in zip(*rows))
                owner, _, h = anchors(Words(list(rows.values())), window)
                yield pa.record_batch([pa.array(h), pa.array(ids[owner]), pa.array(keys[owner])], ["h", "doc_id", "text_hash"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "h long, doc_id long, text_hash long")


STRETCH_SCHEMA = "h long, key binary, doc_id long, at long, stretch binary, whole binary, lot long, members array<struct<key:binary,doc_id:long,at:long>>"


def stretches(texts: DataFrame, window: int) -> DataFrame:
    """Stretches round the anchors of each text (wanted: h and hot), or, round hot ones, their windows.

    A window is told by a 16-byte hash, with all places that have it in the lot of texts at hand,
    so that a passage in any number of texts sends one row a lot.
    """
    gram = min(GRAM, window)
    place = pa.struct([("key", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int64())])
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(place)]
    names = ["h", "key", "doc_id", "at", "stretch", "whole", "lot", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                words = Words(bytes_of(part))
                first = np.concatenate([[0], np.cumsum(words.counts)]).tolist()
                wanted = [{x["h"]: x["hot"] for x in w} for w in part.column("wanted").to_pylist()]
                keys, ids = part.column("key").to_pylist(), part.column("doc_id").to_pylist()
                raw, starts, stops = words.raw, words.starts.tolist(), words.stops.tolist()
                rows: list[tuple] = []
                hot: dict[int, set[int]] = {}
                owner, at, h = anchors(words, window)
                some = np.isin(h, np.fromiter({x for w in wanted for x in w}, np.int64))
                for t, p, x in zip(owner[some].tolist(), at[some].tolist(), h[some].tolist()):
                    kind = wanted[t].get(x)
                    if kind is None:
                        continue
                    low = max(first[t], p + gram - window)
                    if kind:
                        hot.setdefault(t, set()).update(range(low, min(p, first[t + 1] - window) + 1))
                        continue
                    high = min(p + window, first[t + 1])
                    rows.append((x, keys[t], ids[t], low - first[t], raw[starts[low] : stops[high - 1]], None, None, None))
                windows: dict[bytes, list[tuple]] = {}
                for t, places in hot.items():
                    for p in sorted(places):
                        whole = xxhash.xxh3_128_digest(b" ".join(raw[starts[p] : stops[p + window - 1]].split()))
                        windows.setdefault(whole, []).append((keys[t], ids[t], p - first[t]))
                lot = uuid.uuid4().int >> 65
                rows += [(None, None, min(m[1] for m in x), None, None, w, lot, [dict(zip(("key", "doc_id", "at"), m)) for m in x]) for w, x in windows.items()]
                for k in range(0, len(rows), 20_000):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 20_000]), kinds)], names)

    return texts.mapInArrow(run, STRETCH_SCHEMA)


def longest_earlier(symbols: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """At each place the length of the longest piece that starts at a place of a smaller id, too; exact up to depth."""
    n = len(symbols)
    order, levels = suffix_order(symbols, depth)
    prefix = common_prefixes(order, levels)
    out = np.zeros(n, np.int64)
    for back in (False, True):
        # Suffixes that aren't told apart (equal to depth) may stand in any order: prefixes are right up to there.
        by = order[::-1] if back else order
        shared = prefix[1:n][::-1] if back else prefix[1:n]  # of neighbours k and k + 1
        own = ids[by]
        before = nearest_before(np.concatenate([[np.iinfo(np.int64).min], own]))[1:] - 1
        found = np.flatnonzero(before >= 0)
        length = _least_between(np.concatenate([shared, [0]]), before[found], found)
        out[by[found]] = np.maximum(out[by[found]], length)
    return out


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair, low < high."""
    if not len(low):
        return np.zeros(0, np.int64)
    size = high - low
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.zeros(len(low), np.int64)
    least = values
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(least[low[at]], least[high[at] - (1 << k)])
        least = np.minimum(least[: -(1 << k)], least[1 << k :])
    return out


def parsed(longest: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch number, start, stop) of repeats: greedy parse of the stretches begin .. end, all of them step by step."""
    number, at = np.arange(len(begin)), begin.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(number):
        length = np.maximum(longest[at], 1)
        big = longest[at] >= window
        found.append((number[big], at[big], (at + length)[big]))
        # At the boundary: windows that start in this factor and reach over its end.
        for back in range(1, window):
            place = at + length - back
            over = (back < length) & (longest[np.maximum(place, 0)] >= window)
            found.append((number[over], place[over], place[over] + window))
        at = at + length
        on = at < end[number]
        number, at = number[on], at[on]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _block_repeats(rows: list[tuple], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """Spans (by word number) of each text's repeats in a block of rows (key, doc_id, at, stretch)."""
    distinct: dict[bytes, int] = {}
    for _, d, _, x in rows:
        if distinct.setdefault(x, d) > d:
            distinct[x] = d
    words = Words(list(distinct))
    sizes = words.counts + 1
    end = np.cumsum(sizes) - 1
    begin = end - sizes + 1
    symbols = np.empty(int(sizes.sum()), np.int64)
    inner = np.ones(len(symbols), bool)
    inner[end] = False
    symbols[inner] = words.hashes.view(np.int64)
    symbols[end] = np.arange(len(end))  # ends differ, so that no piece crosses them
    ids = np.repeat(np.fromiter(distinct.values(), np.int64), sizes)
    longest = longest_earlier(symbols, ids, 2 * window)
    found: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in zip(*(x.tolist() for x in parsed(longest, begin, end, window))):
        found.setdefault(k, []).append((a - int(begin[k]), b - int(begin[k])))
    number = {x: k for k, x in enumerate(distinct)}
    out: dict[bytes, list[tuple[int, int]]] = {}
    for key, d, at, x in rows:
        # A stretch that an earlier document has as it is repeats as a whole.
        k = number[x]
        spans = found.get(k, ()) if d == distinct[x] else [(0, int(words.counts[k]))] if words.counts[k] >= window else ()
        if spans:
            out.setdefault(key, []).extend((a + at, b + at) for a, b in spans)
    return {k: _merged(x) for k, x in out.items()}


SPAN_SCHEMA = "key binary, spans array<struct<start:long,stop:long>>"


def block_spans(rows: DataFrame, window: int, block_words: int = 60_000) -> DataFrame:
    """(key, spans) of repeats among the stretches of each anchor; anchors share blocks of about so many words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        last = None
        for batch in batches:
            for h, *row in zip(*(batch.column(x).to_pylist() for x in ("h", "key", "doc_id", "at", "stretch"))):
                if h != last and len(block) * (2 * window - GRAM) >= block_words:
                    yield _span_batch(_block_repeats(block, window))
                    block = []
                block.append(tuple(row))
                last = h
        if block:
            yield _span_batch(_block_repeats(block, window))

    return rows.repartition("h").sortWithinPartitions("h").select("h", "key", "doc_id", "at", "stretch").mapInArrow(run, SPAN_SCHEMA)


def _span_batch(spans: dict[bytes, list[tuple[int, int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.record_batch([pa.array(list(spans), pa.binary()), pa.array([[{"start": a, "stop": b} for a, b in _merged(x)] for x in spans.values()], kind)], ["key", "spans"])


def hot_spans(rows: DataFrame, window: int) -> DataFrame:
    """(key, spans) of the windows round hot anchors that an earlier document holds.

    Answers go back to the lots that the windows came from, so that each text of a lot gets its spans at once.
    """
    least = rows.groupBy("whole").agg(F.min("doc_id").alias("first")).withColumnRenamed("whole", "w")
    later = rows.join(least, F.col("whole") == F.col("w")).where(F.exists("members", lambda m: m["doc_id"] > F.col("first")))
    lots = later.groupBy("lot").agg(F.collect_list(F.struct("first", "members")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column("found"):
                spans: dict[bytes, list[tuple[int, int]]] = {}
                for x in found.as_py():
                    for m in x["members"]:
                        if m["doc_id"] > x["first"]:
                            spans.setdefault(m["key"], []).append((m["at"], m["at"] + window))
                yield _span_batch(spans)

    return lots.select("found").mapInArrow(run, SPAN_SCHEMA)


def remaining(texts: DataFrame) -> DataFrame:
    """key, n_removed and kept_sha256 of texts without the words of their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, key, spans in zip(bytes_of(part), part.column("key").to_pylist(), part.column("spans").to_pylist()):
                    words, kept, at = text.split(), [], 0
                    for a, b in _merged([(x["start"], x["stop"]) for x in spans]):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    rows.append((key, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), [pa.binary(), pa.int64(), pa.string()])], ["key", "n_removed", "kept_sha256"])

    return texts.mapInArrow(run, "key binary, n_removed long, kept_sha256 string")


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words and the digest of all words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = bytes_of(part)
                split = [x.split() for x in texts]
                digests = [hashlib.sha256(b" ".join(x)).hexdigest() for x in split]
                yield pa.record_batch([part.column("doc_id"), pa.array([key_of(x) for x in texts], pa.binary()), pa.array([len(x) for x in split], pa.int64()), pa.array(digests)], ["doc_id", "key", "n_words", "all_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, n_words long, all_sha256 string")


def without_earlier(docs: DataFrame, min_words: int = 13, hot_count: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    given = docs.select(F.col("doc_id").cast("long").alias("given_id"), "text")
    docs = given.select(F.coalesce("given_id", F.lit(LAST)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = anchor_rows(docs, min_words)
    counts = rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    # As a table of its own, so that adaptive execution can split the places of a hot anchor in the join.
    counts = written(counts.select(F.col("h").alias("shared"), (F.col("n") > hot_count).alias("hot")), "shared-anchors")
    wanted = anchor_rows(docs, min_words).select("h", "text_hash").join(counts, F.col("h") == F.col("shared")).groupBy("text_hash").agg(F.collect_set(F.struct("h", "hot")).alias("wanted"))
    # One row stands for all with its text: the one of the least doc_id.
    classes = docs.select(text_key().alias("key"), "text_hash", "doc_id").groupBy("key", "text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.join(wanted, "text_hash", "left"), "different-texts")
    whole = docs.select("doc_id", "text", text_key().alias("text_key"))
    own = lambda df: (F.col("text_key") == df["key"]) & (F.col("doc_id") == df["first_id"])
    shared = classes.where("wanted IS NOT NULL")
    texts = whole.join(shared, own(shared)).select("key", "doc_id", "text", "wanted")
    cut = written(stretches(texts, min_words), "stretches")
    spans = block_spans(cut.where("h IS NOT NULL"), min_words).unionByName(hot_spans(cut.where("h IS NULL"), min_words))
    spans = written(spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(classes.select("key", "first_id"), "key"), "repeats")
    left = remaining(whole.join(spans, own(spans)).select("key", "text", "spans")).dropDuplicates(["key"])
    verdict = classes.where("copies > 1").select("key", "first_id").join(left, "key", "full_outer")
    verdict = written(verdict.select(F.col("key").alias("found_key"), "first_id", "n_removed", "kept_sha256"), "removed")
    out = _whole(given.withColumnRenamed("given_id", "doc_id")).join(verdict, F.col("key") == F.col("found_key"), "left")
    gone = (F.coalesce("doc_id", F.lit(LAST)) > F.col("first_id")) & (F.col("n_words") >= min_words)
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )
