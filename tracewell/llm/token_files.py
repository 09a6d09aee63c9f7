"""Token-id files: independent zstandard frames with a seek table and frame checksums.

One file holds the documents of one range of ids in ascending order:

    frame 0 ... frame n-1   one zstandard frame per document: its ids, little-endian u32
    skippable frame         the document ids: n int64, then n validity bytes (zstandard)
    skippable frame         the seek table: per frame the compressed size, the size and the
                            low 32 bits of XXH64 of the content (u32 each), then the frame
                            count (u32), a descriptor byte and the closing magic number

Any zstandard tool can decompress a file; a reader that wants some documents reads the
table at the end and only their frames. Writers name files by partition and attempt, and
only the files of attempts that succeeded are in the manifest, so lost or repeated tasks
leave no wrong data. Files are written through pyarrow's file systems (file, hdfs, s3, gs).

Defined cases: a null or empty text is a document of the end id alone; a null id sorts
first; rows with equal ids keep all their rows, ordered by text; an empty table has no
files and an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, scratch_dir, slices, written
from tracewell.llm.wordbpe import Codes, LibraryEncoder

SKIPPABLE_TABLE, SKIPPABLE_INDEX, TABLE_END = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHECKSUMS = 0x80


class FrameWriter:
    """Writes one file; holds no more than the table of what it has written."""

    def __init__(self, out):
        self.out, self.entries, self.ids = out, [], []
        self.compress = zstandard.ZstdCompressor(level=3).compress

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.compress(content)
        self.out.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = np.array([x or 0 for x in self.ids], "<i8").tobytes() + bytes(x is not None for x in self.ids)
        index = self.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, TABLE_END)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != TABLE_END or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(table_at, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        frames_end = int(self.starts[-1])
        packed = self._at(frames_end + 8, table_at - 8 - frames_end - 8)
        index = zstandard.ZstdDecompressor().decompress(packed)
        ids, valid = np.frombuffer(index[: 8 * n], "<i8"), index[8 * n :]
        self.ids = [k if ok else None for k, ok in zip(ids.tolist(), valid)]

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read."""
        packed, size, check = self.table[k].tolist()
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, "<u4")

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, or those with the wanted ids."""
        keep = None if wanted is None else set(wanted)
        for k, doc_id in enumerate(self.ids):
            if keep is None or doc_id in keep:
                yield doc_id, self.frame(k)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and write all documents; return the manifest (part, file, n_docs, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = name = None
        codes = Codes(LibraryEncoder(path))
        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.ids.zst"
                    writer = FrameWriter(system.open_output_stream(f"{root}/{name}", compression=None))
                ids, _ = codes.ids(bytes_of(part))
                for doc_id, x in zip(part.column("id").to_pylist(), ids):
                    writer.add(doc_id, np.append(x, end_id).astype("<u4").tobytes())
                    total += len(x) + 1
        if writer is not None:
            writer.close()
            row = [context.partitionId()], [name], [len(writer.ids)], [total]
            yield pa.record_batch([pa.array(x) for x in row], ["part", "file", "n_docs", "n_tokens"])

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    # The second key lets rows of one id spread; ranges stay in ascending order.
    ranged = chosen.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return written(ranged.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, id_column: str = "doc_id") -> DataFrame:
    """Read the files of a manifest: id, start, n_tokens and ids_crc32 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(f"{root}/{name}") as source:
                    rows: list[tuple] = []
                    for doc_id, ids in FrameReader(source).documents():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    files = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file; as many tasks as files.
    based = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))
    read = based.repartition(max(1, files)).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return read.withColumnRenamed("id", id_column)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["id", "start", "n_tokens", "ids_crc32"]
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names)


def token_positions(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents as token files in the shared folder and read them back."""
    folder = scratch_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, folder, end_id), folder)
