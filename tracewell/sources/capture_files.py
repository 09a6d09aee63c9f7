"""Files of captured records as a Spark source and sink, for batches and streams.

spark.dataSource.register(CaptureFiles), then format("capture"). Two layouts:

framed  blocks of records behind a header. Every block starts with the 16 random bytes of its
        file and ends where its length says; its checksum tells it from a chance match.
fixed   records of one size, record_size, as a ring buffer keeps them.

Both can be read from any byte on, so that a file of any size is split: a block (or a fixed
record) belongs to the range in which it ends. A stream's offset is the number of bytes known
of each file; what isn't complete yet ends in a later range, and files may grow. A batch also takes
the whole records of a last block that was cut off; a cut record is left out.

Columns: path, offset (of the record's block or, fixed, of the record, in bytes), place (in
its block) and record. Options: path (a folder or a file), layout, record_size,
max_partition_bytes, max_bytes_per_trigger (streams), block_bytes (writing). Folders are read
with pyarrow, which must know their scheme; hidden files (. or _ first) are left out.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tracewell.sources.capture import CAPTURED, HEADER

MAGIC = b"TWCAPT01"
#: After the magic: the file's mark and the most bytes of a block's body.
FILE_HEAD = struct.Struct("<8s16sI")
#: After the mark: bytes of the body, records, checksum of the body.
BLOCK_HEAD = struct.Struct("<III")
SCHEMA = "path string, offset long, place int, record binary"
ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("place", pa.int32()), ("record", pa.binary())])
BATCH = 8192


@dataclass(frozen=True)
class Range:
    """Bytes start (exclusive) to stop (inclusive) of a file, by where blocks end; size: of the file as far as known."""

    path: str
    start: int
    stop: int
    size: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def listed(path: str) -> dict[str, int]:
    """Sizes of the capture files in a folder (or of one file), by path within the file system, sorted."""
    system, inner = _opened(path)
    at = system.get_file_info(inner)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = lambda x: not any(part[0] in "._" for part in x.path[len(inner) :].split("/") if part)
    return {x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and shown(x)}


def packed(ranges: list[Range], most: int) -> list[Ranges]:
    """Ranges cut to most bytes and small ones put together, a partition each."""
    out: list[Ranges] = []
    held = most
    for r in ranges:
        for a in range(r.start, r.stop, most):
            piece = Range(r.path, a, min(a + most, r.stop), r.size)
            n = piece.stop - piece.start
            if held + n > most:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(piece)
            held += n
    return out


def fixed_records(read, r: Range, size: int) -> Iterator[tuple[int, int, bytes]]:
    first, last = r.start // size, r.stop // size  # ends of records, counted
    step = max(1, (4 << 20) // size)
    for k in range(first, last, step):
        data = read(k * size, min(step, last - k) * size)
        for j in range(len(data) // size):
            yield (k + j) * size, 0, data[j * size : (j + 1) * size]


def _records(body: bytes, at: int) -> Iterator[tuple[int, int, bytes]]:
    """Whole records of a block's body."""
    place = k = 0
    while place + 4 <= len(body):
        (n,) = struct.unpack_from("<I", body, place)
        if place + 4 + n > len(body):
            return
        yield at, k, body[place + 4 : place + 4 + n]
        place += 4 + n
        k += 1


def framed_records(read, r: Range, whole: bool) -> Iterator[tuple[int, int, bytes]]:
    """Records of the blocks that end in the range; whole: and of a block that the end of the file cuts."""
    head = read(0, FILE_HEAD.size)
    if len(head) < FILE_HEAD.size:
        return
    magic, mark, limit = FILE_HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError(f"{r.path}: no file of captured blocks")
    lead = len(mark) + BLOCK_HEAD.size
    # A block that ends in the range may start this far before it.
    begin = max(FILE_HEAD.size, r.start + 1 - limit - lead)
    data = read(begin, r.stop - begin)
    at = 0
    while (at := data.find(mark, at)) >= 0:
        body = at + lead
        if body > len(data):
            return
        n, _, checksum = BLOCK_HEAD.unpack_from(data, at + len(mark))
        end = begin + body + n
        if n > limit:
            at += 1
        elif end > r.stop:
            if whole and end > r.size and r.stop == r.size:
                yield from _records(data[body:], begin + at)
                return
            # Its end lies in a later range, unless these bytes only look like a block's start.
            at += 1
        elif zlib.crc32(data[body : body + n]) != checksum:
            at += 1
        else:
            if end > r.start:
                yield from _records(data[body : body + n], begin + at)
            at = body + n


def records_of(source: str, options: dict, ranges: list[Range], whole: bool) -> Iterator[pa.RecordBatch]:
    system, _ = _opened(source)
    rows: list[tuple] = []
    for r in ranges:
        with system.open_input_file(r.path) as f:
            read = lambda at, n: f.read_at(n, at)  # noqa: E731, B023
            found = fixed_records(read, r, options["record_size"]) if options["layout"] == "fixed" else framed_records(read, r, whole)
            for at, place, record in found:
                rows.append((r.path, at, place, record))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), ARROW)], schema=ARROW)


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options

    def partitions(self) -> list[Ranges]:
        return packed([Range(p, 0, n, n) for p, n in listed(self.path).items()], self.options["max_partition_bytes"]) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return records_of(self.path, self.options, partition.ranges, True)


class CaptureStream(DataSourceStreamReader):
    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options
        self.known: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        """Bytes known of each file; at most max_bytes_per_trigger more than in the last batch of this run."""
        sizes, most = listed(self.path), self.options["max_bytes_per_trigger"]
        if most and self.known is not None:
            left, shown = most, dict(self.known)
            for p, n in sizes.items():
                more = min(left, n - shown.get(p, 0))
                if more > 0:
                    shown[p] = shown.get(p, 0) + more
                    left -= more
            sizes = shown
        self.known = sizes
        return {"files": json.dumps(sizes)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return packed([Range(p, old.get(p, 0), n, n) for p, n in new.items() if n > old.get(p, 0)], self.options["max_partition_bytes"])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return records_of(self.path, self.options, partition.ranges, False)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class CaptureWriter(DataSourceWriter):
    """Each task writes a hidden file; all are shown by renaming when the job ends."""

    def __init__(self, path: str, options: dict, column: int):
        self.path, self.options, self.column = path, options, column

    def write(self, iterator: Iterator) -> Written:
        system, inner = _opened(self.path)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/.{uuid.uuid4().hex}.capture"
        fixed, limit = self.options["layout"] == "fixed", self.options["block_bytes"]
        mark = os.urandom(16)
        with system.open_output_stream(name) as out:
            if not fixed:
                out.write(FILE_HEAD.pack(MAGIC, mark, limit))
            body, n = bytearray(), 0
            for row in iterator:
                record = bytes(row[self.column])
                if fixed:
                    if len(record) > self.options["record_size"]:
                        raise ValueError("a record is longer than record_size")
                    out.write(record.ljust(self.options["record_size"], b"\0"))
                    continue
                if len(record) + 4 > limit:
                    raise ValueError("a record is longer than block_bytes")
                if len(body) + 4 + len(record) > limit:
                    out.write(mark + BLOCK_HEAD.pack(len(body), n, zlib.crc32(body)) + body)
                    body, n = bytearray(), 0
                body += struct.pack("<I", len(record)) + record
                n += 1
            if n:
                out.write(mark + BLOCK_HEAD.pack(len(body), n, zlib.crc32(body)) + body)
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = _opened(self.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(name, f"{inner}/{name.rsplit('/', 1)[1][1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for message in messages:
            for name in message.files if message else []:
                system.delete_file(name)


class CaptureFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        given = {k.lower(): v for k, v in self.options.items()}
        layout = given.get("layout", "framed")
        if layout not in ("framed", "fixed"):
            raise ValueError(f"no layout {layout}")
        numbers = {"record_size": HEADER + CAPTURED, "max_partition_bytes": 64 << 20, "max_bytes_per_trigger": 0, "block_bytes": 256 << 10}
        return {"layout": layout} | {k: int(given.get(k, v)) for k, v in numbers.items()}

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("capture files need a path")
        return path.rstrip("/")

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self._path(), self._options())

    def streamReader(self, schema) -> CaptureStream:  # noqa: N802
        return CaptureStream(self._path(), self._options())

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        if overwrite:
            raise ValueError("capture files are appended to")
        return CaptureWriter(self._path(), self._options(), schema.fieldNames().index("record"))
