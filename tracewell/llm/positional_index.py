"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings of every word of the training documents and is built once, whatever
is asked later. It is split by documents: each entry holds some MB of them as sorted posting lists
(term, word positions), so that no list of a frequent word meets in one task and building it takes
no shuffle. It is stored as a table in the shared folder. A query goes to every entry; there, its
terms are ordered by list length and the lists, shifted by the term's offset, are intersected from
the rarest term on, until nothing is left. Terms are 64-bit hashes of words (XXH64); two different
words are taken for one with a chance of 2^-64 a pair.

Test items are sent to the executors in blocks of at most block_bytes of text; each block is
answered by the same stored index over all documents. Of a block, an entry looks only at the items
whose windows have all terms in it.

Defined cases: words are runs of [0-9a-z] and non-ASCII signs after lower-casing A-Z; a null
or empty text has no words and no hits; an item of fewer words than a window is one window,
one without words is none; equal rows get equal results; items with equal text all count;
matches don't cross documents; empty tables give empty results or rows without hits; only
the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import bytes_of, key_of, slices, text_key, unused, written

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INDEX_SCHEMA = "doc_ids array<long>, text_keys array<binary>, starts binary, terms binary, stops binary, positions binary"
HIT_SCHEMA = "doc_id long, text_key binary, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def term_of(word: bytes) -> int:
    """A word's term: its XXH64 as a signed number."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class TestSet:
    """The different windows of a block of test items, in flat arrays of some 20 bytes a word.

    words holds the numbers of all items' words (places in the sorted terms), one item after
    another; window k is words[starts[k] : starts[k] + widths[k]] and stands in the items
    names[x] for x in owners[bounds[k] : bounds[k + 1]].
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        split = [(str(item_id), np.fromiter(map(term_of, words_of((text or "").encode())), np.int64)) for item_id, text in items]
        split = [x for x in split if len(x[1])]
        self.names = [name for name, _ in split]
        sizes = np.array([len(x) for _, x in split], np.int64)
        self.terms, words = np.unique(np.concatenate([*(x for _, x in split), np.zeros(0, np.int64)]), return_inverse=True)
        self.words = words.astype(np.int32)
        counts = np.maximum(sizes - window, 0) + 1
        first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(split)), counts)
        widths = np.repeat(np.minimum(sizes, window), counts)
        starts, wide, owners, held = [], [], [], []
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            rows = np.lib.stride_tricks.sliding_window_view(self.words, w)[first[at]]
            _, one, of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(of.reshape(-1) * (len(split) + 1) + owner[at])
            starts.append(first[at][one])
            wide.append(np.full(len(one), w))
            owners.append(pairs % (len(split) + 1))
            held.append(np.bincount(pairs // (len(split) + 1), minlength=len(one)))
        joined_ = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        self.starts, self.widths, self.owners = (joined_(x).astype(np.int32) for x in (starts, wide, owners))
        self.bounds = np.concatenate([[0], np.cumsum(joined_(held))]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.starts)

    def window(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.starts[k] + self.widths[k]]

    def items(self, k: int) -> list[str]:
        return [self.names[x] for x in self.owners[self.bounds[k] : self.bounds[k + 1]].tolist()]

    def within(self, numbers: np.ndarray) -> np.ndarray:
        """The windows all of whose terms have a number."""
        missing = np.concatenate([[0], np.cumsum(numbers[self.words] < 0)])
        return np.flatnonzero(missing[self.starts + self.widths] == missing[self.starts])


class Entry:
    """Posting lists of some documents. Positions count words over all of them, with a gap after each document."""

    def __init__(self, row: dict):
        self.doc_ids, self.text_keys = row["doc_ids"], row["text_keys"]
        self.starts = np.frombuffer(row["starts"], np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        self.terms = np.frombuffer(row["terms"], np.int64)
        self.stops = np.concatenate([[0], np.frombuffer(row["stops"], np.int64)])
        self.positions = np.cumsum(np.frombuffer(unpack(row["positions"]), np.int32), dtype=np.int64) if len(self.terms) else np.zeros(0, np.int64)

    @staticmethod
    def build(doc_ids: list, texts: list[bytes]) -> dict:
        known: dict[bytes, int] = {}
        split = [words_of(x) for x in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in split])]).astype(np.int64)
        total = int(starts[-1]) - len(split)
        # Words are numbered as they come, so that each different one is hashed once and rows sort by small numbers.
        flat = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(split)), np.int64, total)
        terms = np.fromiter(map(term_of, known), np.int64, len(known))
        by_term = np.argsort(terms)
        rank = np.empty(len(terms), np.int32)
        rank[by_term] = np.arange(len(terms))
        at = np.arange(total) + np.repeat(np.arange(len(split)), np.diff(starts) - 1)
        place = rank[flat] if total else np.zeros(0, np.int32)
        counts = np.bincount(place, minlength=len(terms))
        steps = np.diff(at[np.argsort(place, kind="stable")], prepend=0).astype(np.int32)
        return {
            "doc_ids": doc_ids,
            "text_keys": [key_of(x) for x in texts],
            "starts": starts.tobytes(),
            "terms": terms[by_term].tobytes(),
            "stops": np.cumsum(counts).astype(np.int64).tobytes(),
            "positions": zstandard.ZstdCompressor(level=1).compress(steps.tobytes()),
        }

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand in this entry, -1 for those it doesn't have."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def postings(self, number: int) -> np.ndarray:
        return self.positions[self.stops[number] : self.stops[number + 1]] if number >= 0 else np.zeros(0, np.int64)

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """First positions of all exact occurrences of terms that the entry has."""
        order = np.argsort(self.stops[numbers + 1] - self.stops[numbers], kind="stable")
        at = self.postings(numbers[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            other = self.postings(numbers[k])
            where = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
            at = at[other[where] == at + k]
        return at

    def near(self, numbers: np.ndarray, within: int) -> list[tuple[int, int]]:
        """(first, last) position of every smallest stretch of at most within words, in one document, that holds all terms."""
        lists = [self.postings(t) for t in dict.fromkeys(numbers.tolist())]
        if not all(map(len, lists)):
            return []
        out = set()
        for first in lists:
            last = first.copy()
            whole = np.ones(len(first), bool)
            for other in lists:
                where = np.searchsorted(other, first)
                whole &= where < len(other)
                last = np.maximum(last, other[np.minimum(where, len(other) - 1)])
            document = np.searchsorted(self.starts, first, "right")
            whole &= (last - first < within) & (last < self.starts[np.minimum(document, len(self.starts) - 1)])
            out.update(zip(first[whole].tolist(), last[whole].tolist()))
        # Of stretches with one end, the shortest; those that hold another fall away.
        ends: dict[int, int] = {}
        for a, b in out:
            ends[b] = max(a, ends.get(b, -1))
        return sorted((a, b) for b, a in ends.items())

    def rows(self, spans_of: dict[int, list], items_of: dict[int, set]) -> Iterator[tuple]:
        lengths = np.diff(self.starts) - 1
        for d, (doc_id, key) in enumerate(zip(self.doc_ids, self.text_keys)):
            yield doc_id, key, int(lengths[d]), spans_of.get(d, []), sorted(items_of.get(d, ()))

    def search(self, test: TestSet) -> Iterator[tuple]:
        """One row per document: covered spans of words, and the items whose windows occur."""
        spans: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        numbers = self.numbers(test.terms)
        for k in test.within(numbers).tolist():
            terms = test.window(k)
            at = self.phrase(numbers[terms])
            if len(at):
                documents = np.searchsorted(self.starts, at, "right") - 1
                for d, a in zip(documents.tolist(), (at - self.starts[documents]).tolist()):
                    spans[d].append((a, a + len(terms)))
                    items[d].update(test.items(k))
        return self.rows({d: joined(x) for d, x in spans.items()}, items)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def build_index(docs: DataFrame, entry_bytes: int = 6_000_000) -> DataFrame:
    """Store the postings of all words; one row per entry of about entry_bytes of text."""
    kind = T._parse_datatype_string(INDEX_SCHEMA)
    fields = pa.schema([("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.binary())), *((f.name, pa.binary()) for f in kind.fields[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", entry_bytes, 100_000):
                yield pa.RecordBatch.from_pylist([Entry.build(part.column("doc_id").to_pylist(), bytes_of(part))], fields)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA), "positional-index")


def _searched(index: DataFrame, test: TestSet) -> DataFrame:
    shipped = index.sparkSession.sparkContext.broadcast(test)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(span), pa.list_(pa.string())]
    names = ["doc_id", "text_key", "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [(d, key, n, [{"start": a, "stop": b} for a, b in spans], items) for d, key, n, spans, items in Entry(batch.slice(k, 1).to_pylist()[0]).search(shipped.value)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return index.mapInArrow(run, HIT_SCHEMA)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The test items, at most block_bytes of text at the driver at a time (or one longer item)."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(row["text"] or "")
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    yield held


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000, index: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, n_words, spans (of words, stop exclusive) and items of every document. index: of docs, if there is one already.

    With more than one block, the blocks' rows of one document are united by (doc_id, key of
    the text); rows with both equal have equal results and keep their number.
    """
    index = build_index(docs) if index is None else index
    found = [_searched(index, TestSet(items, window)) for items in blocks_of(benchmark, block_bytes)]
    if len(found) == 1:
        return found[0]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionAll(more)
    grouped = whole.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(found)).cast("int").alias("copies"),
    )
    kind = "array<struct<start:bigint,stop:bigint>>"
    # Sorted spans: one that touches the last joins it, any other is added.
    merge = F.expr(f"""aggregate(all_spans, cast(array() AS {kind}), (done, x) -> CASE
        WHEN size(done) > 0 AND try_element_at(done, -1).stop >= x.start THEN concat(slice(done, 1, size(done) - 1),
            cast(array(struct(try_element_at(done, -1).start AS start, greatest(try_element_at(done, -1).stop, x.stop) AS stop)) AS {kind}))
        ELSE concat(done, cast(array(x) AS {kind})) END)""")
    return grouped.select("doc_id", "text_key", "n_words", merge.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def proximity_matches(docs: DataFrame, queries: list[tuple[str, str]], within: int) -> DataFrame:
    """(doc_id, query, first, last): stretches of at most within words that hold all words of a query, in any order."""
    test = TestSet(queries, 1 << 30)
    wanted = [(test.items(k), test.window(k)) for k in range(len(test))]
    index = build_index(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                entry = Entry(batch.slice(k, 1).to_pylist()[0])
                numbers, rows = entry.numbers(test.terms), []
                for items, terms in wanted:
                    for a, b in entry.near(numbers[terms], within):
                        d = int(np.searchsorted(entry.starts, a, "right")) - 1
                        rows += [(entry.doc_ids[d], item, a - int(entry.starts[d]), b - int(entry.starts[d])) for item in items]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", "query", "first", "last"])

    return index.mapInArrow(run, "doc_id long, query string, first long, last long")


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest of phrase_matches: n_words, n_hit, n_items, items_sha256 and contaminated."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return phrase_matches(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with their columns as they are.

    A hit is a matter of the text alone, so each row is decided by its own text, whatever its id.
    """
    (hit_key,) = unused(docs.columns, "hit_key")
    bad = phrase_matches(docs, benchmark, window).where(F.size("spans") > 0).select(F.col("text_key").alias(hit_key)).distinct()
    return docs.join(bad, text_key() == F.col(hit_key), "left_anti")
