"""Depth, root and critical path of spans in traces of any depth, by pointer jumping.

Every span points to its parent; a round lets it point to where its target points, so that
distances double and a chain of n spans takes about log2 n joins on unique keys. Each round is
a table in the shared folder. The critical path of a trace goes from its root to the child that ends last
(of equal ones the smallest id), and on from there.

A span whose parent isn't there is a root; spans of a cycle, and below one, have no depth and
no root and lie on no path; of rows with one trace and span id, the first by all columns counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources import scratch


def depths(spans: DataFrame, max_rounds: int = 40) -> DataFrame:
    """trace_id, span_id, depth (0 for roots), root_id and critical of every span; reads ids, start_time and duration_us."""
    keys = ["trace_id", "span_id"]
    ended = (F.unix_micros("start_time") + F.col("duration_us")).alias("ended")
    rows = spans.groupBy(*keys).agg(F.min(F.struct(F.col("parent_span_id").alias("parent"), ended)).alias("x")).select(*keys, "x.parent", "x.ended")
    rows = scratch.written(rows, "tree-spans")
    there = rows.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"))
    placed = rows.join(there, (F.col("trace_id") == F.col("t")) & (F.col("parent") == F.col("s")), "left").select(*keys, "ended", F.col("s").alias("target"))
    # The child of each span that ends last; an aggregate, as one span may have any number of them.
    last = placed.where("target IS NOT NULL").groupBy(F.col("trace_id").alias("t"), F.col("target").alias("p")).agg(F.max_by("span_id", F.struct("ended", -F.col("span_id"))).alias("last_child"))
    state = placed.join(last, (F.col("trace_id") == F.col("t")) & (F.col("target") == F.col("p")), "left").select(
        *keys, "target", F.when(F.col("target").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), (F.col("target").isNull() | (F.col("span_id") == F.col("last_child"))).alias("critical"), F.coalesce("target", "span_id").alias("root_id")
    )
    state = scratch.written(state, "tree-0")
    for k in range(1, max_rounds + 1):
        left = state.where("target IS NOT NULL")
        before = left.count()
        if not before:
            break
        by = state.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("target").alias("next"), F.col("depth").alias("more"), F.col("critical").alias("also"), F.col("root_id").alias("root"))
        moved = left.join(by, (F.col("trace_id") == F.col("t")) & (F.col("target") == F.col("s")))
        moved = moved.select(*keys, F.col("next").alias("target"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("critical") & F.col("also")).alias("critical"), F.col("root").alias("root_id"))
        state = scratch.written(state.where("target IS NULL").unionByName(moved), f"tree-{k}")
        if k > 1 and state.where("target IS NOT NULL").count() == before and _no_longer(state, k):
            break
    open_ = F.col("target").isNotNull()
    return state.select(*keys, F.when(~open_, F.col("depth")).alias("depth"), F.when(~open_, F.col("root_id")).alias("root_id"), (~open_ & F.col("critical")).alias("critical"))


def _no_longer(state: DataFrame, rounds: int) -> bool:
    """Whether what is still open can only be cycles: jumps of 2^rounds are longer than the largest trace."""
    most = state.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (1 << rounds) > most
