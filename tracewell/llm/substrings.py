"""Suffix-array dedup: remove every byte of a string of min_bytes that stands elsewhere too.

Equal texts are one text with a number of copies. Each string of min_bytes has one anchor,
the 64-byte gram of least hash in it (of equal ones the first): equal strings have equal
anchors at the same place. Anchors that stand once in the corpus are dropped. For each of
the others a segment is cut that holds just the strings whose anchor it is, so that each
string is searched once, and segments of one anchor meet in one task. There the strings are taken in classes
of 48 by their place relative to the anchor, and by the bytes that all strings of a class
share, their core. What stands around the core differs; for the core, a number is written,
which keeps repeats as they are and makes texts short. Interval expansion on the
Burrows-Wheeler transform of those texts (bwt.py) finds the strings that repeat.

Hot anchors (more than hot_count places) leave the map task by class and core rather than
by anchor, so that they are dealt out. Equal segments within a map task are settled there: all but one of them
leave it as results, so that a passage in any number of texts sends a few rows per task.

The same search runs in a second unit: a text's words (runs without ASCII white space), each
a symbol of 3 bytes of its hash and one item of the search. It finds passages of min_words words that stand elsewhere
too, shorter than min_bytes or differently spaced ones included; they are told, not removed.
Two different words are taken for one with a chance of 2^-24.

Defined cases: null and empty texts have nothing to remove; texts under min_bytes keep
everything; overlapping occurrences count (a long run of one byte removes itself); equal
rows are copies of each other; a null doc_id is kept as it is; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bwt import INNER, repeated_ranges
from tracewell.llm.common import bytes_of, slices, written

CLASS = 48
SYMBOL = 3  # bytes of a word's symbol
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 16
PLACE = np.uint64((1 << 24) - 1)  # bits of a place in a block, below a hash


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass(frozen=True)
class Unit:
    """What repeats: strings of least items; anchors are grams of gram items. Items are bytes, or words: word symbols."""

    words: bool
    least: int
    gram: int

    @property
    def width(self) -> int:
        """Bytes of an item."""
        return SYMBOL if self.words else 1

    def values(self, raw: np.ndarray) -> np.ndarray:
        """A number for each item."""
        if not self.words:
            return VALUES[raw]
        out = sum(raw[k::SYMBOL].astype(np.uint64) << np.uint64(8 * k) for k in range(SYMBOL)) + np.uint64(1)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out * BASE


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SPACE = _space()
VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POWERS = _powers(BASE, 4096)


def word_symbols(texts: list[bytes]) -> list[bytes]:
    """The symbols of each text's words, one after another."""
    counts, parts = [], []
    for at, stop in _pieces([len(x) for x in texts]):
        raw = np.frombuffer(b" ".join(texts[at:stop]) + b" ", np.uint8)
        gap = SPACE[raw]
        before = np.concatenate([[True], gap[:-1]])
        begin = np.flatnonzero(~gap & before)
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts[at:stop]])])
        counts += np.diff(np.searchsorted(begin, bounds)).tolist()
        if not len(begin):
            continue
        first = begin[0]
        place = np.arange(first, len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
        terms = VALUES[raw[first:]] * POWERS[place & 4095]
        terms[gap[first:]] = 0
        h = np.add.reduceat(terms, begin - first)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        parts.append(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 8 - SYMBOL :]).tobytes())
    whole, cuts = b"".join(parts), (np.concatenate([[0], np.cumsum(counts)]) * SYMBOL).astype(int).tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def _pieces(sizes: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together, or one longer text."""
    at = held = 0
    for k, n in enumerate(sizes):
        if k > at and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if sizes:
        yield at, len(sizes)


class Anchors:
    """Anchors of texts, found together block by block."""

    def __init__(self, unit: Unit):
        self.unit, self.gram, self.least = unit, unit.gram, unit.least
        self.window = self.least - self.gram + 1
        if BLOCK + self.least > int(PLACE):
            raise ValueError(f"strings of {self.least} items are too long")
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> list[pa.Array]:
        """Lists of each text: hashes of its anchors, their places, how far before each its first string starts, and how far after that its last one."""
        sizes = np.array([len(x) for x in texts], np.int64) // self.unit.width
        long = sizes >= self.least
        sizes *= long
        ends = np.cumsum(sizes)
        values = self.unit.values(np.frombuffer(b"".join(x for x, use in zip(texts, long) if use), np.uint8))
        stop = np.repeat(ends, sizes)
        found = [(np.zeros(0, np.int64),) * 4]
        for a in range(0, len(values) - self.least + 1, BLOCK):
            part = slice(a, a + BLOCK + self.least - 1)
            h, *where = self._block(values[part], np.arange(a, min(part.stop, len(values))) + self.least <= stop[part])
            found.append((h, *(x + a for x in where)))
        hashes, places, low, high = (np.concatenate(x) for x in zip(*found))
        # An anchor on whose strings two blocks meet is one.
        change = places[1:] != places[:-1]
        first, last = np.append(len(places) > 0, change), np.append(change, len(places) > 0)
        if len(places):
            hashes, places, low, high = hashes[first], places[first], low[first], high[last]
        starts = ends - sizes
        bounds = np.append(np.searchsorted(places, starts), len(places)).astype(np.int32)
        own = places - np.repeat(starts, np.diff(bounds))
        return [pa.ListArray.from_arrays(bounds, x) for x in (hashes, own, places - low, high - low)]

    def _block(self, values: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place, start of the first string, start of the last one) of anchors. inside: whether the string that starts at a place stays in its text."""
        n = len(values)
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        g = (sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        w = self.window
        # Least hash of each string with its place, from the running minima of blocks of w, forwards and backwards.
        rows = -(-len(g) // w)
        padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(g)] = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
        grid = padded.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        starts = np.flatnonzero(inside[: len(g) - w + 1])
        at = (np.minimum(behind[starts], ahead[starts + w - 1]) & PLACE).astype(np.int64)
        if not len(at):
            return at, at, at, at
        change = at[1:] != at[:-1]
        first, last = np.append(True, change), np.append(change, True)
        return g[at[first]].view(np.int64), at[first], starts[first], starts[last]


LISTS = [kind + x for kind in ("", "word_") for x in ("hashes", "places", "backs", "mores")]


def described(docs: DataFrame, units: tuple[Unit, Unit]) -> DataFrame:
    """doc_id, key (SHA-256 of the text), n_bytes, n_words and anchors (in bytes, then in word symbols) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_bytes, in_words = map(Anchors, units)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = bytes_of(part)
                coded = word_symbols(texts)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                        pa.array([len(x) for x in texts], pa.int64()),
                        pa.array([len(x) // SYMBOL for x in coded], pa.int64()),
                        *in_bytes(texts),
                        *in_words(coded),
                    ],
                    ["doc_id", "key", "n_bytes", "n_words", *LISTS],
                )

    lists = ", ".join(f"{x} array<long>" for x in LISTS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, key binary, n_bytes long, n_words long, {lists}")


SEGMENT_SCHEMA = "bucket long, segment binary, key binary, place long, several boolean, stop long, pivot int, level int, words boolean"


def classes(pivot: int, size: int, unit: Unit) -> Iterator[tuple[int, int, int, int, int]]:
    """(class, low, high, core start, core stop) of the strings around an anchor at pivot in a segment of size items.

    Strings of the class start in low .. high and all hold the core.
    """
    window = unit.least - unit.gram + 1
    for k in range(max(0, pivot - size + unit.least) // CLASS * CLASS, min(window, pivot + 1), CLASS):
        most = min(CLASS, window - k) - 1
        yield k, max(0, pivot - k - most), min(pivot - k, size - unit.least), pivot - k, pivot - k - most + unit.least


def cut_segments(texts: DataFrame, units: tuple[Unit, Unit]) -> DataFrame:
    """Segments around repeated anchors, one row each; rows with a stop are results already."""

    def around(unit: Unit, h: int, p: int, back: int, more: int, text: bytes, hot: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """(bucket, start, stop, pivot, level) of the segments of an anchor.

        The pivot is the anchor's place in the segment; for a hot one it is the core's, and level its class.
        """
        start, size, width = p - back, more + unit.least, unit.width
        if not hot:
            yield h, start, start + size, back, -1
            return
        for k, low, high, core, end in classes(back, size, unit):
            yield xxhash.xxh64_intdigest(text[(start + core) * width : (start + end) * width], k) - (1 << 63), start + low, start + high + unit.least, core - low, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000, 100_000):
                found: dict[tuple, tuple[bytes, int]] = {}
                several: set[tuple] = set()
                settled: dict[tuple[bytes, bool], list[tuple[int, int]]] = {}
                texts, lists = bytes_of(part), part.column("anchors")
                anchors = zip(*(x.to_pylist() for x in lists.flatten().flatten()))
                for raw, coded, key, n in zip(texts, word_symbols(texts), part.column("key").to_pylist(), lists.value_lengths().to_pylist()):
                    for h, p, back, more, w, hot in islice(anchors, n):
                        text, width = (coded, SYMBOL) if w else (raw, 1)
                        for bucket, a, b, pivot, level in around(units[w], h, p, back, more, text, hot):
                            name = (bucket, text[a * width : b * width], pivot, level, w)
                            first = found.setdefault(name, (key, a))
                            if first != (key, a):
                                if name not in several:
                                    several.add(name)
                                    settled.setdefault((first[0], w), []).append((first[1], first[1] + b - a))
                                settled.setdefault((key, w), []).append((a, b))
                names = list(found)
                for k in range(0, len(names), 5000):
                    some = names[k : k + 5000]
                    yield _segment_batch([(n[0], n[1], *found[n], n in several, None, n[2], n[3], n[4]) for n in some])
                rows = [(xxhash.xxh64_intdigest(key) - (1 << 63), None, key, a, True, b, None, None, w) for (key, w), spans in settled.items() for a, b in _merged(spans)]
                for k in range(0, len(rows), 20000):
                    yield _segment_batch(rows[k : k + 20000])

    return texts.mapInArrow(run, SEGMENT_SCHEMA)


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["bucket", "segment", "key", "place", "several", "stop", "pivot", "level", "words"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Block:
    """Strings of some buckets, for one run of the interval expansion per length."""

    def __init__(self, unit: Unit):
        self.unit, self.inner = unit, 1 if unit.words else INNER
        self.out: dict[bytes, list[tuple[int, int]]] = {}
        self.numbers: dict[bytes, int] = {}
        self.symbols = self.cores = 0
        self.runs: dict[int, tuple[list, list, list, list, list]] = {}

    def add(self, rows: list[tuple]) -> None:
        """A bucket's rows (segment, key, place, several, pivot, level)."""
        if len(rows) == 1 and not rows[0][3]:
            return
        distinct: dict[tuple, list] = {}
        for segment, key, place, many, pivot, level in rows:
            entry = distinct.setdefault((segment, pivot, level), [set(), False])
            entry[0].add((key, place))
            entry[1] |= many
        least, width = self.unit.least, self.unit.width
        if len(distinct) == 1:
            (((segment, _, _), (where, many)),) = distinct.items()
            if many or len(where) > 1:
                self._settle(where, 0, len(segment) // width)
            return
        cored: dict[tuple, list[tuple]] = {}
        for (segment, pivot, level), (where, many) in distinct.items():
            size = len(segment) // width
            if level >= 0:
                most = min(CLASS, least - self.unit.gram + 1 - level) - 1
                found = [(level, 0, size - least, pivot, pivot - most + least)]
            else:
                found = classes(pivot, size, self.unit)
            for k, low, high, core, end in found:
                name = (k, segment[core * width : end * width])
                around = (segment, low, core, end, high + least, where, many)
                if name in cored:
                    cored[name].append(around)
                else:
                    cored[name] = [around]
        for found in cored.values():
            if len(found) == 1:
                ((_, low, _, _, stop, where, many),) = found
                if many or len(where) > 1:
                    self._settle(where, low, stop)
                continue
            parts: dict[tuple, list] = {}
            for segment, low, core, end, stop, where, many in found:
                entry = parts.setdefault((segment[low * width : core * width], segment[end * width : stop * width]), [[], False])
                entry[0].append((where, low))
                entry[1] |= many
            self._strings(end - core, parts)

    def _settle(self, where: set, start: int, stop: int) -> None:
        for key, place in where:
            if key in self.out:
                self.out[key].append((place + start, place + stop))
            else:
                self.out[key] = [(place + start, place + stop)]

    def _strings(self, core: int, parts: dict[tuple, list]) -> None:
        """Texts around one core; equal ones in two places are settled, a single one has no repeat."""
        width = self.unit.width
        for (left, right), entry in parts.items():
            entry[1] |= len(entry[0]) > 1 or len(entry[0][0][0]) > 1
            if entry[1]:
                for where, low in entry[0]:
                    self._settle(where, low, low + (len(left) + len(right)) // width + core)
        if len(parts) < 2:
            return
        length = self.unit.least - core + self.inner
        strings, owners, several, inner, places = self.runs.setdefault(length, ([], [], [], [], []))
        filler = bytes(self.inner * width)
        for (left, right), (wheres, many) in parts.items():
            where, low = wheres[0]
            key, place = next(iter(where))
            string = left + filler + right
            strings.append(string)
            owners.append((self.numbers.setdefault(key, len(self.numbers)), place + low))
            several.append(many)
            inner.append((len(left) // width, self.cores))
            places.append(wheres)
            self.symbols += len(string) // width + 1
        self.cores += 1

    def finish(self) -> dict[bytes, list[tuple[int, int]]]:
        for length, (strings, owners, several, inner, places) in self.runs.items():
            # All strings of a class hold its core, so that repeated ones of one text are a single stretch.
            for k, first, last in repeated_ranges(strings, owners, several, length, inner, self.unit.width):
                if several[k]:
                    continue  # settled whole
                for where, low in places[k]:
                    self._settle(where, low + first, low + last + self.unit.least)
        return self.out


def repeated_spans(segments: DataFrame, units: tuple[Unit, Unit], block_symbols: int = 1 << 18) -> DataFrame:
    """(key, words, spans) of repeated stretches, from the segments of each bucket together."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def batch_of(found: dict[bytes, list[tuple[int, int]]], words: bool) -> pa.RecordBatch:
        spans = [[{"start": a, "stop": b} for a, b in _merged(x)] for x in found.values()]
        return pa.record_batch([pa.array(list(found), pa.binary()), pa.array([words] * len(found), pa.bool_()), pa.array(spans, kind)], ["key", "words", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, rows, last = [Block(x) for x in units], [], None
        for batch in batches:
            done: tuple[dict, dict] = ({}, {})
            for bucket, segment, key, place, many, stop, pivot, level, words in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if segment is None:
                    done[words].setdefault(key, []).append((place, stop))
                    continue
                if (bucket, words) != last:
                    if rows:
                        blocks[last[1]].add(rows)
                        if blocks[last[1]].symbols >= block_symbols:
                            yield batch_of(blocks[last[1]].finish(), last[1])
                            blocks[last[1]] = Block(units[last[1]])
                    rows, last = [], (bucket, words)
                rows.append((segment, key, place, many, pivot, level))
            for words in (False, True):
                if done[words]:
                    yield batch_of(done[words], words)
        if rows:
            blocks[last[1]].add(rows)
        for words in (False, True):
            yield batch_of(blocks[words].finish(), words)

    return segments.repartition("bucket", "words").sortWithinPartitions("bucket", "words").mapInArrow(run, "key binary, words boolean, spans array<struct<start:long,stop:long>>")


def remaining(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 and n_passage_words of texts with repeated spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, key, spans, passages in zip(bytes_of(part), *(part.column(x).to_pylist() for x in ("key", "spans", "passages"))):
                    spans, passages = (_merged([(x["start"], x["stop"]) for x in y]) for y in (spans, passages))
                    ends = [0, *(b for _, b in spans)]
                    kept = b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))
                    rows.append((key, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in passages)))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["key", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    return texts.mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def without_repeats(docs: DataFrame, min_bytes: int = 400, min_words: int = 51, hot_count: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and n_passage_words.

    The last counts words in passages of at least min_words words that stand elsewhere too.
    """
    units = (Unit(False, min_bytes, min(64, min_bytes)), Unit(True, min_words, min(8, min_words)))
    rows = written(described(docs, units), "anchors")
    # One row stands for all with its text: the one of the least doc_id.
    distinct = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep_id"), F.min(F.struct(*LISTS)).alias("x"))
    both = [F.expr(f"transform(arrays_zip(x.{h}, x.{p}, x.{b}, x.{m}), z -> struct(z.{h} AS h, z.{p} AS p, z.{b} AS back, z.{m} AS more, {w} AS w))") for h, p, b, m, w in ((*LISTS[:4], "false"), (*LISTS[4:], "true"))]
    distinct = written(distinct.select("key", "copies", "rep_id", F.concat(*both).alias("anchors")), "different-texts")
    places = distinct.select("key", "rep_id", F.explode("anchors").alias("x")).select("key", "rep_id", "x.*")
    # As a table of its own, so that adaptive execution can split the places of a hot anchor in the join.
    counts = places.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("hash"), F.col("w").alias("of_words"), (F.col("n") > hot_count).alias("hot"))
    counts = written(counts, "repeated-anchors")
    wanted = places.join(counts, (F.col("h") == F.col("hash")) & (F.col("w") == F.col("of_words"))).groupBy("key", "rep_id").agg(F.collect_list(F.struct("h", "p", "back", "more", "w", "hot")).alias("anchors"))
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(utf8, 256)).alias("text_key"))
    texts = whole.join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("key", "text", "anchors")
    texts = written(texts, "texts-with-repeats")
    spans = repeated_spans(cut_segments(texts, units), units)
    of = lambda words: F.flatten(F.collect_list(F.when(F.col("words") == words, F.col("spans"))))
    spans = spans.groupBy("key").agg(of(False).alias("spans"), of(True).alias("passages")).withColumnRenamed("key", "span_key")
    left = remaining(texts.select("key", "text").join(spans, F.col("key") == F.col("span_key")).select("key", "text", "spans", "passages")).dropDuplicates(["key"])
    # Texts with copies go whole, if they are long enough; for others, what the search found.
    empty = hashlib.sha256(b"").hexdigest()
    copied = distinct.where("copies > 1").select("key", F.lit(True).alias("copied"))
    verdict = copied.join(left, "key", "full_outer").select(F.col("key").alias("found_key"), "copied", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
    out = rows.select("doc_id", "key", "n_bytes", "n_words").join(written(verdict, "removed"), F.col("key") == F.col("found_key"), "left")
    gone = F.col("copied") & (F.col("n_bytes") >= min_bytes)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
        F.when(F.col("copied") & (F.col("n_words") >= min_words), F.col("n_words")).otherwise(F.coalesce("n_passage_words", F.lit(0))).cast("long").alias("n_passage_words"),
    )
