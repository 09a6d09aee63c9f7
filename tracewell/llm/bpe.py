"""BPE encoding and decoding of whole documents: speculate and verify.

Proposals and checks are in wordbpe.SpeculativeEncoder. This module runs them over a
DataFrame: one Arrow pass without a shuffle, memory bounded by chunks of about 2 MB of
text (one longer text is a chunk of its own).

Defined cases: null and empty texts have no tokens and decode to the empty text; equal
rows give equal rows; an empty table gives an empty result; only the id and text columns
are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, slices
from tracewell.llm.wordbpe import Codes, SpeculativeEncoder


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id, ids array<int> and decoded string for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(SpeculativeEncoder(path), decode=True)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, decoded = codes.ids(bytes_of(part))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(bounds, flat), pa.array([x.decode() for x in decoded], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def encoding_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id, n_tokens, ids_sha256 and decoded_sha256 for each row.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8, so that long token lists need not leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(SpeculativeEncoder(path), decode=True)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, decoded = codes.ids(bytes_of(part))
                yield pa.record_batch(
                    [
                        part.column("id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
