"""The stored roll-up: partial rows by batch, compacted level by level, of which readers always see one whole version.

Every batch adds a folder of partial rows (rollup.partial). Once fan_in folders of a level are
there, they are merged into one of the next level, so that a row is rewritten once a level and a
reader opens few folders. Adding and compacting are commits of the table's list of folders
(versions.py): a reader sees the folders of before or of after, never both. Each folder's first and
last window stand in the list, so that a query over a time opens only those that reach into it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators import rollup
from tracewell.sources import versions

SCHEMA = (
    "project_id string, service_id string, environment_id string, http_route string, http_method string, window_start timestamp, "
    "request_count bigint, error_count bigint, total_duration_us bigint, min_us bigint, max_us bigint, sketch binary"
)

PART_ROWS = 100_000  # rows that a task of a compaction merges about


def _folders(made: versions.Version) -> dict[str, dict[str, Any]]:
    return made.notes.get("folders", {})


def _written(rows: DataFrame, path: str, level: int) -> tuple[str, dict[str, Any] | None]:
    """A folder of rows, each file by tenant and time, and what the list says of it; None for no rows.

    Rows stay in the tasks that made them: few tenants have most rows, and no task takes a whole one.
    """
    name = versions.fresh(f"level-{level}")
    at = f"{path.rstrip('/')}/{name}"
    spark = rows.sparkSession
    ordered = rows.select(*[f.name for f in spark.createDataFrame([], SCHEMA).schema]).sortWithinPartitions("project_id", "service_id", "window_start")
    ordered.write.parquet(at)
    first, last, n = spark.read.schema(SCHEMA).parquet(at).agg(F.min(F.unix_timestamp("window_start")), F.max(F.unix_timestamp("window_start")), F.count(F.lit(1))).first()
    return name, None if not n else {"level": level, "first": first, "last": last, "rows": n}


def _committed(spark: SparkSession, path: str, change: Callable[[versions.Version], dict[str, Any] | None], tries: int = 20) -> versions.Version:
    """Commit the list that change makes of the newest one (None: leave it); again if another writer came first."""
    for _ in range(tries):
        former = versions.version(spark, path)
        notes = change(former)
        if notes is None:
            return former
        try:
            return versions.commit(spark, path, former, sorted(notes["folders"]), notes)
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{path}: other writers came first {tries} times")


def append(spans: DataFrame, path: str, source: str = "", batch_id: int | None = None) -> versions.Version:
    """Add the partial rows of spans; a batch of a source that is there already, or older, isn't added again."""
    spark = spans.sparkSession
    done = lambda made: batch_id is not None and made.notes.get("sources", {}).get(source, -1) >= batch_id
    now = versions.version(spark, path)
    if done(now):
        return now
    name, told = _written(rollup.partial(spans), path, 0)

    def change(former: versions.Version) -> dict[str, Any] | None:
        if done(former):
            return None
        sources = former.notes.get("sources", {}) | ({source: batch_id} if batch_id is not None else {})
        return {"folders": _folders(former) | ({name: told} if told else {}), "sources": sources}

    return _committed(spark, path, change)


def compact(spark: SparkSession, path: str, fan_in: int = 8) -> versions.Version:
    """Merge every level that has fan_in folders or more into one folder of the next, level after level."""
    while True:
        made = versions.version(spark, path)
        by_level: dict[int, list[str]] = {}
        for name, told in _folders(made).items():
            by_level.setdefault(told["level"], []).append(name)
        full = sorted(k for k, x in by_level.items() if len(x) >= max(2, fan_in))
        if not full:
            return made
        old = by_level[full[0]]
        parts = max(spark.sparkContext.defaultParallelism, math.ceil(sum(_folders(made)[f]["rows"] for f in old) / PART_ROWS))
        merged = rollup.remerged(spark.read.schema(SCHEMA).parquet(*[f"{path.rstrip('/')}/{f}" for f in old]), parts)
        name, told = _written(merged, path, full[0] + 1)

        def change(former: versions.Version, old: list[str] = old, name: str = name, told: dict | None = told) -> dict[str, Any] | None:
            there = _folders(former)
            if not all(f in there for f in old):
                return None  # another compaction took them
            return {"folders": {f: x for f, x in there.items() if f not in old} | ({name: told} if told else {}), "sources": former.notes.get("sources", {})}

        _committed(spark, path, change)


def read(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None, number: int | None = None) -> DataFrame:
    """Partial rows of a version (the newest, unless a number is given) whose windows start in since .. until; times without a zone are UTC."""
    made = versions.version(spark, path, number)
    second = lambda t: None if t is None else (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()
    a, b = second(since), second(until)
    wanted = [f for f, x in _folders(made).items() if (a is None or x["last"] >= a) and (b is None or x["first"] <= b)]
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*[f"{path.rstrip('/')}/{f}" for f in wanted])
    if a is not None:
        rows = rows.where(F.col("window_start") >= F.lit(since))
    return rows if b is None else rows.where(F.col("window_start") <= F.lit(until))


def sink(spans: DataFrame, path: str, checkpoint: str, source: str = "stream", fan_in: int = 8, **trigger) -> StreamingQuery:
    """Every batch of a stream of spans adds its partial rows, once however often it runs, and compacts what is due."""

    def step(batch: DataFrame, batch_id: int) -> None:
        append(batch, path, source, batch_id)
        compact(batch.sparkSession, path, fan_in)

    return spans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
