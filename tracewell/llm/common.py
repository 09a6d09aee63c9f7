"""What the operators share: scratch tables, Arrow batching and word patterns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import scratch

#: Words of several contracts: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, which spark.checkpoint.dir names; only a local master may go without it."""
    return scratch.path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no column has it (upper and lower case are one to Spark)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16 bytes of the SHA-256 of the text; null counts as empty. Rows of equal texts share it."""
    return F.substring(F.unhex(F.sha2(F.encode(text_of(column), "UTF-8"), 256)), 1, 16)


def key_of(text: bytes) -> bytes:
    """text_key in Python."""
    return hashlib.sha256(text).digest()[:16]


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % modulus


def crc_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch with about most_bytes of text each.

    A single text longer than that is a piece of its own: texts are never cut.
    """
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and (held + size > most_bytes or k - at >= most_rows):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as str; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 without decoding; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
