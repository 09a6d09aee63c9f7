"""Modified Kneser-Ney over the word bigrams of a language, whatever their number.

Nothing of it is gathered at the driver or broadcast. Texts are taken in chunks, each cut
anew from the same table by three passes:

1. The hashes of a chunk's different bigrams go, sorted, to the part that holds their range.
   There the counts of all chunks are summed; each chunk gets back the totals of its own
   bigrams, and one of the chunks with a bigram is told to be the one that stands for it.
2. A chunk sends its different words to the part of the word's range, with sums over the
   bigrams it stands for (followers, and different words before). There the sums are added
   up; each chunk gets back those of its own words.
3. The chunk is scored with its answers.

Answers are stored by chunk in the shared folder; a task reads those of its chunk only. So
each task holds one part or one chunk; the number of parts follows the bytes of text.

Words are split at ASCII white space with A-Z lower-cased, and told apart by 48 bits of a
hash (bigrams by 56); id 0 stands before the first word of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, scratch_dir, slices, written
from tracewell.llm.wordbpe import _Numbers

PART_BYTES, CHUNK_BYTES = 32_000_000, 16_000_000
WORD_BITS, PAIR_BITS = 48, 56
ROW = "lang string, part int, chunk string, kind int, data binary"
SCHEMA = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("chunk", pa.string()), ("kind", pa.int32()), ("data", pa.binary())])
COUNTS, STATS, KINDS = range(3)


def word_hash(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word, 7) >> (64 - WORD_BITS)) or 1


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 in 7 planes of bytes an array; planes of zeros cost nothing."""
    planes = [np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :7].T for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, arrays: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(arrays, 7, -1)
    out = np.zeros((arrays, planes.shape[2], 8), np.uint8)
    out[:, :, :7] = planes.transpose(0, 2, 1)
    return out.view("<i8")[:, :, 0]


def steps(values: np.ndarray) -> np.ndarray:
    """Sorted values as differences."""
    return np.diff(values, prepend=0)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair of words."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Bigrams:
    """Different bigrams (sorted by hash) and words (sorted) of some texts, and where they are in them."""

    def __init__(self, texts: list[bytes]):
        numbers, split = _Numbers(), [x.lower().split() for x in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        b = np.fromiter((k for x in split for k in map(numbers.__getitem__, x)), np.int64, int(sizes.sum()))
        del split
        self.ends = np.cumsum(sizes)
        self.words, rank = np.unique(np.array([0, *map(word_hash, numbers)], np.int64), return_inverse=True)
        b = rank[b + 1]
        a = np.concatenate([[0], b[:-1]])[: len(b)]
        a[(self.ends - sizes)[sizes > 0]] = 0
        key = (mixed(self.words[a], self.words[b]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        self.keys, self.n = key[starts], np.diff(starts, append=len(key))
        self.at = np.empty(len(key), np.int64)
        self.at[order] = np.cumsum(new) - 1
        self.a, self.b = a[order[starts]], b[order[starts]]


def runs(values: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, stop) of the ranges of sorted hashes that have some."""
    width = (1 << bits) // parts + 1
    stops = np.searchsorted(values, np.arange(1, parts + 1) * width).tolist()
    yield from ((p, i, j) for p, (i, j) in enumerate(zip([0, *stops], stops)) if i < j)


def by_language(part: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, list[bytes]]]:
    """Each language with its rows and their texts."""
    texts, rows = bytes_of(part), {}
    for k, lang in enumerate(part.column("lang").to_pylist()):
        rows.setdefault(lang, []).append(k)
    for lang, mine in rows.items():
        yield lang, np.array(mine), [texts[k] for k in mine]


def chunk_key(lang: str | None, texts: list[bytes]) -> str:
    """The same texts of a language have the same bigrams and answers."""
    digest = xxhash.xxh3_128(repr(lang).encode())
    for x in texts:
        digest.update(len(x).to_bytes(8, "little") + x)
    return digest.hexdigest()


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, SCHEMA.types)], schema=SCHEMA)


#: Steps of a plan that give the same rows in the same order each time, if files are split alike.
STEADY = {"FileScan", "Project", "Filter", "ColumnarToRow", "InputAdapter", "WholeStageCodegen", "AdaptiveSparkPlan", "BatchScan"}


def frozen(docs: DataFrame) -> DataFrame:
    """docs such that every pass cuts it into the same chunks.

    What is more than a scan of files (a shuffle, a Python step, a retried stage may each give
    rows in another order) is written to a table first. Files are split by the number of cores
    that Spark has at the time, which may change between passes, unless
    spark.sql.files.minPartitionNum says how many parts there are: so that is set for the session, if it isn't yet.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    found = {m for line in plan.splitlines() for m in re.findall(r"^[\s:+\-*]*(?:\(\d+\) )?([A-Za-z]+)", line)}
    return docs if found <= STEADY else written(docs, "frozen")


def per_chunk(docs: DataFrame, rows_of) -> DataFrame:
    """Rows that rows_of gives for (lang, chunk key, bigrams) of each chunk and language.

    All passes cut the same table into the same chunks; with other ones they would not find the answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES, 1 << 30):
                for lang, _, texts in by_language(part):
                    g = Bigrams(texts)
                    if len(g.keys):
                        yield from table_of(rows_of(lang, chunk_key(lang, texts), g)).to_batches()

    return docs.mapInArrow(run, ROW)


def _grouped(table: pa.Table) -> tuple[str | None, int, list[str], list[bytes]]:
    return table.column("lang")[0].as_py(), table.column("part")[0].as_py(), table.column("chunk").to_pylist(), table.column("data").to_pylist()


def counted(table: pa.Table) -> pa.Table:
    """Of one part: for each chunk twice the totals of its bigrams, plus 1 where it stands for them; and the counts of counts."""
    lang, part, chunks, data = _grouped(table)
    got = [unpacked(x, 2) for x in data]
    key, n = np.concatenate([np.cumsum(x[0]) for x in got]), np.concatenate([x[1] for x in got])
    stops = np.cumsum([x.shape[1] for x in got])
    # Chunks of equal texts share their key and answers; the first of them may stand for a bigram.
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)
    answer = 2 * total[at]
    answer[first] += 1
    rows, told = [], set()
    for chunk, x in zip(chunks, np.split(answer, stops[:-1])):
        if chunk not in told:
            told.add(chunk)
            rows.append((lang, part, chunk, COUNTS, packed(x)))
    rows.append((lang, part, None, KINDS, packed(np.array([(total == k).sum() for k in (1, 2, 3, 4)] + [len(total)]))))
    return table_of(rows)


def summed(table: pa.Table) -> pa.Table:
    """Of one part of words: the sums of each chunk's words."""
    lang, part, chunks, data = _grouped(table)
    own = {c: unpacked(x, 6) for c, x in zip(chunks, data)}
    names = [np.cumsum(x[0]) for x in own.values()]
    words, at = np.unique(np.concatenate(names), return_inverse=True)
    sums = np.concatenate([x[1:] for x in own.values()], axis=1)
    whole = np.array([np.bincount(at, x, len(words)) for x in sums]).astype(np.int64)
    return table_of([(lang, part, c, STATS, packed(*whole[:, np.searchsorted(words, x)])) for c, x in zip(own, names)])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    if not n1 or not n2 or not n3:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])


def _kinds(table: pa.Table) -> pa.Table:
    lang, _, _, data = _grouped(table)
    return table_of([(lang, 0, None, KINDS, packed(sum(unpacked(x, 1)[0] for x in data)))])


def _stored(answers: DataFrame, name: str) -> str:
    """The folder of the answers, one folder a chunk; a chunk's are some MB."""
    path = scratch_dir(answers.sparkSession, name)
    answers.withColumnRenamed("chunk", "folder").drop("lang").repartition("folder").sortWithinPartitions("folder").write.partitionBy("folder").parquet(path)
    return path


def fit(docs: DataFrame) -> tuple[str, str]:
    """Folders of the answers about bigrams and about words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1

    def bigrams(lang: str | None, chunk: str, g: Bigrams) -> list[tuple]:
        return [(lang, p, chunk, COUNTS, packed(steps(g.keys[i:j]), g.n[i:j])) for p, i, j in runs(g.keys, PAIR_BITS, parts)]

    counts = written(per_chunk(docs, bigrams).groupBy("lang", "part").applyInArrow(counted, ROW), "word-counts")
    # One row of five numbers a part.
    wholes = counts.where(F.col("kind") == KINDS).groupBy("lang").applyInArrow(_kinds, ROW).select(F.col("lang").alias("l"), F.col("data").alias("kinds"))
    pairs = _stored(counts.where(F.col("kind") == COUNTS).join(F.broadcast(wholes), F.col("lang").eqNullSafe(F.col("l"))).drop("l"), "bigram-answers")

    def words(lang: str | None, chunk: str, g: Bigrams) -> list[tuple]:
        total, stands, _ = totals(folder_rows(pairs, chunk))
        n = len(g.words)
        sums = [np.bincount(g.a, x * stands, n) for x in (total, total == 1, total == 2, total > 2)] + [np.bincount(g.b, stands, n)]
        return [(lang, p, chunk, STATS, packed(steps(g.words[i:j]), *(x[i:j] for x in sums))) for p, i, j in runs(g.words, WORD_BITS, parts)]

    return pairs, _stored(per_chunk(docs, words).groupBy("lang", "part").applyInArrow(summed, ROW), "word-answers")


def totals(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Total count of each of a chunk's bigrams, whether the chunk stands for it, and the language's counts of counts and kinds."""
    found = np.concatenate([unpacked(r["data"], 1)[0] for r in sorted(rows, key=lambda r: r["part"])])
    return found >> 1, found & 1, unpacked(rows[0]["kinds"], 1)[0].tolist()


def folder_rows(path: str, folder: str) -> list[dict]:
    """Rows of a folder in the shared storage, read where the task runs."""
    system, at = pa.fs.FileSystem.from_uri(f"{path}/folder={folder}")
    files = [x.path for x in system.get_file_info(pa.fs.FileSelector(at)) if x.base_name.startswith("part-")]
    return [r for x in files for r in pa.parquet.ParquetFile(system.open_input_file(x)).read().to_pylist()]


def text_bits(lang: str | None, texts: list[bytes], pairs: str, words: str) -> np.ndarray:
    """Bits per word of each text of a chunk; 0 for texts without words."""
    g = Bigrams(texts)
    if not len(g.keys):
        return np.zeros(len(texts))
    chunk = chunk_key(lang, texts)
    total, _, (*counts, kinds) = totals(folder_rows(pairs, chunk))
    follow, one, two, more, before = np.concatenate([unpacked(r["data"], 5) for r in sorted(folder_rows(words, chunk), key=lambda r: r["part"])], axis=1)
    d = discounts(*counts)
    spared = d[0] * one + d[1] * two + d[2] * more
    # Each bigram and word was counted, so none of these is zero.
    p = (total - d[np.minimum(total, 3) - 1] + spared[g.a] * before[g.b] / kinds) / follow[g.a]
    sums = np.concatenate([[0], np.cumsum(-np.log2(p)[g.at])])
    bounds = np.concatenate([[0], g.ends])
    return np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)


def chunk_bits(chunk: pa.RecordBatch, pairs: str, words: str) -> np.ndarray:
    """Bits per word of each row of a chunk."""
    out = np.zeros(chunk.num_rows)
    for lang, mine, texts in by_language(chunk):
        out[mine] = text_bits(lang, texts, pairs, words)
    return out
