"""Aggregates over sliding ranges of a whole-number order, with work per row that doesn't grow with the range.

A frame (a, b) of a row at sec holds the rows of (sec - a, sec - b] of its keys; rows are unique
by keys and sec. Sums are differences of running sums. Extremes come from blocks as long as the
frame, which then reaches over two of them: the running extreme of the later one from its front
and of the earlier one from its back. Order statistics are read from a wavelet matrix of the
samples of a chunk of time and of the frame before it. Windows here grow from the start, so
that Spark updates them row by row, and share one partitioning by the keys.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Frames = dict[str, tuple[int, int]]


def _up_to(column: str, keys: list[str], distance: int):
    """The column at the last row not after sec - distance."""
    return F.last(column).over(Window.partitionBy(*keys).orderBy("sec").rangeBetween(Window.unboundedPreceding, -distance))


def with_sums(rows: DataFrame, keys: list[str], columns: Iterable[str], frames: Frames) -> DataFrame:
    """{frame}_{column}: sums over the frames, 0 without rows; whole numbers and decimals only, as they are exact."""
    columns = list(columns)
    running = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = {c: f"_running_{c}" for c in columns}
    out = rows.withColumns({names[c]: F.coalesce(F.sum(c).over(running), F.lit(0)) for c in columns})
    zero = F.lit(0)
    totals = {f"{f}_{c}": F.coalesce(_up_to(names[c], keys, b), zero) - F.coalesce(_up_to(names[c], keys, max(a, b)), zero) for f, (a, b) in frames.items() for c in columns}
    return out.withColumns(totals).drop(*names.values())


def with_extremes(rows: DataFrame, keys: list[str], low: str, high: str, frames: Frames) -> DataFrame:
    """{frame}_{low} and {frame}_{high}: the least and the greatest over the frames, null without rows."""
    for name, (a, b) in frames.items():
        length = a - b
        if length <= 0:
            rows = rows.withColumns({f"{name}_{c}": F.lit(None).cast(rows.schema[c].dataType) for c in (low, high)})
            continue
        block = F.floor(F.col("sec") / length)
        rows = rows.withColumn("_block", block)
        ahead = Window.partitionBy(*keys, "_block").orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        behind = Window.partitionBy(*keys, "_block").orderBy(F.desc("sec")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = lambda w: F.struct(F.col("_block").alias("block"), F.min(low).over(w).alias("low"), F.max(high).over(w).alias("high"))
        rows = rows.withColumns({"_ahead": both(ahead), "_behind": both(behind)})
        # The first row after sec - a, found from the far end.
        backwards = Window.partitionBy(*keys).orderBy(F.desc("sec")).rangeBetween(Window.unboundedPreceding, a - 1)
        rows = rows.withColumns({"_end": _up_to("_ahead", keys, b), "_begin": F.last("_behind").over(backwards)})
        last, first = F.floor((F.col("sec") - b) / length), F.floor((F.col("sec") - (a - 1)) / length)
        own_end = F.col("_end.block") == last
        own_begin = (F.col("_begin.block") == first) & (first < last)
        ends = lambda c: (F.when(own_end, F.col(f"_end.{c}")), F.when(own_begin, F.col(f"_begin.{c}")))  # noqa: E731, B023
        rows = rows.withColumns({f"{name}_{low}": F.least(*ends("low")), f"{name}_{high}": F.greatest(*ends("high"))}).drop("_block", "_ahead", "_behind", "_end", "_begin")
    return rows


class Ranks:
    """The k-th smallest of any stretch of values: a wavelet matrix over their ranks, asked for many stretches at once."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.ordered = values[order]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        self.levels = []
        for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
            zero = (rank >> bit & 1) == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)])))
            rank = np.concatenate([rank[zero], rank[~zero]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in values[low:high]; k must lie in the stretch."""
        found = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            left = k < b - a
            found |= np.where(left, 0, 1 << bit)
            k = np.where(left, k, k - (b - a))
            low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
        return self.ordered[found]


def nearest_ranks(sec: np.ndarray, samples: list, frames: Frames, quantiles: dict[str, float]) -> dict[str, np.ndarray]:
    """{frame}_{quantile} at every row, by the nearest rank ceil(n p); 0 without samples. Rows are in order of sec."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in samples], dtype=np.int64)])
    ranks = Ranks(np.concatenate([np.asarray(x, np.int64) for x in samples]) if len(samples) else np.zeros(0, np.int64))
    out = {}
    for name, (a, b) in frames.items():
        low, high = (bounds[np.searchsorted(sec, sec - d, "right")] for d in (max(a, b), b))
        n = high - low
        some = np.flatnonzero(n > 0)
        for q, p in quantiles.items():
            found = np.zeros(len(sec))
            k = np.minimum(np.maximum(np.ceil(n[some] * p).astype(np.int64), 1), n[some]) - 1
            found[some] = ranks.smallest(low[some], high[some], k)
            out[f"{name}_{q}"] = found
    return out


def with_quantiles(rows: DataFrame, keys: list[str], samples: str, frames: Frames, quantiles: dict[str, float]) -> DataFrame:
    """rows without their samples (sorted or not), with {frame}_{quantile} of the samples of the frames.

    Time is cut into chunks as long as the longest frame; a group holds one chunk and the one before it.
    """
    chunk = max(max(a for a, _ in frames.values()), 1)
    kept = [c for c in rows.columns if c != samples]
    at = F.floor(F.col("sec") / chunk)
    placed = rows.withColumn("_at", F.explode(F.array(F.struct(at.alias("chunk"), F.lit(True).alias("own")), F.struct((at + 1).alias("chunk"), F.lit(False).alias("own")))))
    placed = placed.select(*rows.columns, F.col("_at.chunk").alias("_chunk"), F.col("_at.own").alias("_own"))
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(f"{f}_{q}", T.DoubleType()) for f in frames for q in quantiles])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sec")
        own = group["_own"].to_numpy()
        found = nearest_ranks(group["sec"].to_numpy(np.int64), group[samples].tolist(), frames, quantiles) if own.any() else {}
        out = group.loc[own, kept]
        return out.assign(**{f.name: found[f.name][own] if found else [] for f in schema.fields[len(kept) :]})

    return placed.groupBy(*keys, "_chunk").applyInPandas(run, schema)
