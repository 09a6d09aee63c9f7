"""Quality rules: base counts of a text and an n-gram perplexity band of its language.

Two models a language, both modified Kneser-Ney and both keyed by lang itself. Words: bigrams
of words, as many as the corpus holds (word_model.py); they find salad of fluent words.
Spelling: order 4 over 32 classes of a UTF-8 byte (white space, the letters without case,
digits, marks, other signs, and two classes of lead bytes; continuation bytes share the
letters' classes), so that a language's table has 4 MB. The counts cover every document and
are summed by Spark. Models stay in the shared folder; a task reads those it needs.

Verdict: bits per symbol must lie in the band of the document's language, the median of
all its documents plus and minus a multiple of their median deviation; bits per word must
not lie above theirs (copies of a text lie below and are left to deduplication). Histograms
of all documents give both; nothing is sampled.

Defined cases: a null text has no words; a text without words has no perplexity and fails
by its base counts; a null language is a language of its own; equal rows get equal results;
an empty table gives an empty result; other columns pass through untouched or are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import word_model
from tracewell.llm.common import bytes_of, scratch_dir, slices, written
from tracewell.llm.wordbpe import _Numbers

ORDER, SYMBOLS = 4, 32
GRAMS = SYMBOLS**ORDER
BINS_PER_BIT = 256
SIGNS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def symbol_table() -> np.ndarray:
    """Class of each byte."""
    table = np.full(256, 29, np.uint32)
    table[list(SPACE)] = 0
    for k in range(26):
        table[[65 + k, 97 + k]] = k + 1
    table[48:58] = 27
    table[list(b".,;:'\"()!?-")] = 28
    table[0x80:0xC0] = 1 + np.arange(64) % 26
    table[0xC0:0xE0] = 30
    table[0xE0:] = 31
    return table


def flags(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SYMBOL, IS_SIGN, IS_SPACE = symbol_table(), flags(SIGNS), flags(SPACE)


class Flat:
    """Texts of a chunk as one byte array; ends has the end of each text."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(x) for x in texts], dtype=np.int64)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marks each text has."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return np.diff(sums[np.concatenate([[0], self.ends])])


def repeated_words(split: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    sizes = np.array([len(x) for x in split], np.int64)
    total = int(sizes.sum())
    if total < 3:
        return np.zeros(len(split), np.int64)
    numbers = _Numbers()
    word = np.fromiter((k for x in split for k in map(numbers.__getitem__, x)), np.int64, total)
    owner = np.repeat(np.arange(len(split)), sizes)
    if len(numbers) < 1 << 21:
        key = (word[:-2] << 42) | (word[1:-1] << 21) | word[2:]
    else:
        _, pair = np.unique(word[:-1] * len(numbers) + word[1:], return_inverse=True)
        key = pair[:-1] * len(numbers) + word[2:]
    at = np.flatnonzero(owner[:-2] == owner[2:])
    at = at[np.argsort(key[at], kind="stable")]
    same = (key[at[1:]] == key[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    twice = np.zeros(total, bool)
    twice[at[1:][same]] = twice[at[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return np.bincount(owner, covered, len(split)).astype(np.int64)


def measures(flat: Flat) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    split = [x.split() for x in flat.texts]
    lines = [[y for y in x.split(b"\n") if y.strip()] for x in flat.texts]
    starts = (flat.bytes & 0xC0) != 0x80
    return [
        np.array([len(x) for x in split], np.int64),
        flat.per_text(starts & ~IS_SPACE[flat.bytes]),
        flat.per_text(IS_SIGN[flat.bytes]),
        np.array([len(x) - len(set(x)) for x in lines], np.int64),
        repeated_words(split),
    ]


def gram_codes(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of the chunk, one per symbol, each text after three spaces; and the bounds of texts."""
    texts = len(flat.texts)
    symbols = np.zeros(len(flat.bytes) + (ORDER - 1) * texts, np.uint32)
    owner_shift = (ORDER - 1) * np.arange(1, texts + 1)
    lengths = np.diff(flat.ends, prepend=0)
    symbols[np.arange(len(flat.bytes)) + np.repeat(owner_shift, lengths)] = SYMBOL[flat.bytes]
    codes = symbols[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        codes |= symbols[ORDER - 1 - back : len(symbols) - back] << np.uint32(5 * back)
    keep = np.ones(len(codes), bool)  # grams that end in the next text's leading spaces are of no text
    for k in range(ORDER - 1):
        keep[(flat.ends + owner_shift - (ORDER - 1) + k)[:-1]] = False
    return codes[keep], np.concatenate([[0], flat.ends])


def count_grams(docs: DataFrame) -> DataFrame:
    """Counts (lang, gram, n) over all documents, summed within tasks before the shuffle."""

    def rows(tables: dict[str | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            for k in range(0, len(at), 50_000):
                some = at[k : k + 50_000]
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(table[some])], ["lang", "gram", "n"])
        tables.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, _, texts in word_model.by_language(part):
                    codes, _ = gram_codes(Flat(texts))
                    tables[lang] = tables.get(lang, 0) + np.bincount(codes, minlength=GRAMS)
                    if len(tables) > 8:  # of 8 MB each
                        yield from rows(tables)
        yield from rows(tables)

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, gram int, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class KneserNey:
    """Modified Kneser-Ney, interpolated at all orders, as sorted arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams = grams[order].astype(np.uint32)
        counts = counts[order].astype(np.int64)
        lower = np.full(1, 1.0 / SYMBOLS)
        levels = [(self.grams, counts)]
        for k in range(1, ORDER):
            # A shorter gram counts by the different symbols seen before it.
            kinds, n = np.unique(levels[-1][0] & np.uint32(SYMBOLS ** (ORDER - k) - 1), return_counts=True)
            levels.append((kinds, n))
        for kinds, n in reversed(levels):
            d = discounts(n)
            head = kinds // SYMBOLS
            size = lower.size * SYMBOLS
            total = np.bincount(head, n, max(1, size // SYMBOLS))
            spared = np.bincount(head, np.choose(np.minimum(n, 3) - 1, d), max(1, size // SYMBOLS))
            share = np.where(total > 0, spared / np.maximum(total, 1), 1.0)
            full = np.repeat(share, SYMBOLS) * np.tile(lower, size // lower.size)
            full[kinds] += (n - np.choose(np.minimum(n, 3) - 1, d)) / total[head]
            if size < GRAMS:
                lower = full
            else:
                self.back_off, self.lower = np.log2(share).astype(np.float32), np.log2(lower).astype(np.float32)
                self.log2 = np.log2(full[kinds]).astype(np.float32)

    def table(self) -> np.ndarray:
        """log2 probability of every gram: seen ones from their array, others backed off."""
        full = (self.back_off[:, None] + np.tile(self.lower, SYMBOLS).reshape(-1, SYMBOLS)).ravel()
        full[self.grams] = self.log2
        return full


def language_key(lang: str | None) -> str:
    return hashlib.sha256(repr(lang).encode()).hexdigest()


def fit(docs: DataFrame) -> str:
    """Folder of the spelling models, one folder a language, each from at most 2**20 counts."""

    def run(rows: pa.Table) -> pa.Table:
        model = KneserNey(rows.column("gram").to_numpy(), rows.column("n").to_numpy())
        data = zstandard.ZstdCompressor(level=1).compress(model.table().tobytes())
        return pa.table([pa.array([language_key(rows.column("lang")[0].as_py())]), pa.array([data], pa.binary())], ["folder", "data"])

    path = scratch_dir(docs.sparkSession, "spelling-models")
    count_grams(docs).groupBy("lang").applyInArrow(run, "folder string, data binary").write.partitionBy("folder").parquet(path)
    return path


class Scorer:
    """Measures, languages, bits per symbol and bits per word of the texts of a batch."""

    def __init__(self, spelling: str, words: tuple[str, str]):
        self.words = words

        @lru_cache(16)
        def table(lang: str | None) -> np.ndarray:
            data = word_model.folder_rows(spelling, language_key(lang))[0]["data"]
            return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.float32)

        self.table = table

    def spelling_bits(self, part: pa.RecordBatch) -> np.ndarray:
        bits = np.zeros(part.num_rows)
        for lang, mine, texts in word_model.by_language(part):
            codes, bounds = gram_codes(Flat(texts))
            if len(codes):
                sums = np.concatenate([[0], np.cumsum(self.table(lang)[codes], dtype=np.float64)])
                bits[mine] = -np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)
        return bits

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
        for chunk in slices(batch, "text", word_model.CHUNK_BYTES, 1 << 30):
            words, at = word_model.chunk_bits(chunk, *self.words), 0
            for part in slices(chunk, "text"):
                yield part, measures(Flat(bytes_of(part))), self.spelling_bits(part), words[at : at + part.num_rows]
                at += part.num_rows


def scored(docs: DataFrame, spelling: str, words: tuple[str, str]) -> DataFrame:
    """doc_id, the measures, lang, bits per symbol and bits per word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(spelling, words)
        for batch in batches:
            for part, found, bits, word_bits in score(batch):
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, found), part.column("lang"), pa.array(bits), pa.array(word_bits)], names)

    names = ["doc_id", *(x.split()[0] for x in MEASURES.split(", ")), "lang", "bits", "word_bits"]
    return docs.mapInArrow(run, f"doc_id long, {MEASURES}, lang string, bits double, word_bits double")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scores: DataFrame, width: float, least_bits: float) -> dict[str | None, tuple[float, float, float]]:
    """Lower and upper bits per symbol and upper bits per word by language: median and median deviation of the texts that pass the base rules."""
    fine = scores.where(~base_failed())
    out: dict[str | None, tuple] = {}
    for column in ("bits", "word_bits"):
        found: dict[str | None, list] = {}
        for r in fine.groupBy("lang", F.floor(F.col(column) * BINS_PER_BIT).cast("int").alias("bin")).count().collect():
            found.setdefault(r["lang"], []).append((r["bin"], r["count"]))
        for lang, some in found.items():
            bins, n = np.array(sorted(some)).T
            value = (bins + 0.5) / BINS_PER_BIT
            middle = _median(value, n)
            reach = max(width * 1.4826 * _median(np.abs(value - middle), n), least_bits)
            out[lang] = (*out.get(lang, ()), middle + reach) if column == "word_bits" else (middle - reach, middle + reach)
    return out


def _median(value: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(value, kind="stable")
    held = np.cumsum(n[order])
    return float(value[order][np.searchsorted(held, held[-1] / 2)])


def learned(docs: DataFrame, width: float, least_bits: float) -> tuple[DataFrame, tuple[str, tuple[str, str]], dict[str | None, tuple[float, float, float]]]:
    """The stored scores, the models and the limits of the languages; docs must be frozen (word_model.frozen)."""
    models = fit(docs), word_model.fit(docs)
    scores = written(scored(docs, *models), "perplexity")
    return scores, models, bands(scores, width, least_bits)


def quality_rules(docs: DataFrame, width: float = 5.0, least_bits: float = 0.1) -> DataFrame:
    """doc_id, the measures, bits, base_failed and kept of every document."""
    scores, _, limits = learned(word_model.frozen(docs.select("doc_id", "text", "lang")), width, least_bits)
    rows = docs.sparkSession.createDataFrame([(k, *x) for k, x in limits.items()], "of string, low double, high double, word_high double")
    judged = scores.join(F.broadcast(rows), F.col("lang").eqNullSafe(F.col("of")), "left")
    inside = F.col("bits").between(F.col("low"), F.col("high")) & (F.col("word_bits") <= F.col("word_high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("of", "lang", "low", "high", "word_high", "word_bits")


def kept_documents(docs: DataFrame, width: float = 5.0, least_bits: float = 0.1) -> DataFrame:
    """The documents that quality_rules keeps, with their columns as they are.

    Texts are scored once for the bands and once more for the verdict: that costs less
    than to store or shuffle them.
    """
    docs = word_model.frozen(docs)
    _, models, limits = learned(docs, width, least_bits)
    shipped = docs.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, score = shipped.value, Scorer(*models)
        for batch in batches:
            for part, (n_words, _, _, _, repeated), bits, word_bits in score(batch):
                low, high, top = np.array([limits.get(x, (-np.inf, np.inf, np.inf)) for x in part.column("lang").to_pylist()]).reshape(-1, 3).T
                yield part.filter(pa.array((n_words >= 50) & (100 * repeated <= 50 * n_words) & (bits >= low) & (bits <= high) & (word_bits <= top)))

    return docs.mapInArrow(run, docs.schema)
