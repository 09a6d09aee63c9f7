"""Assembly of a stream with a bound on the connections that it remembers.

Connections are dealt over buckets; a bucket keeps its connections in a map of the state store
(RocksDB) and has its share of the bound. After each batch a bucket over its share forgets the
connections whose last event is oldest, by arrival; one that has been idle for idle_ms of event
time is forgotten by a timer. A connection's entry outlives its close as long as that, since the number of closes tells
later ids apart; after being forgotten it starts with a new number of its own, so that ids stay different.
What was forgotten for want of room is told in rows of their own, to be counted or looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.spans import ns_to_timestamp
from tracewell.operators import assembly

#: evicted: the connection that was forgotten (the span's columns are null then), else null.
ROW = f"{assembly.SPAN_ROW}, evicted string"
#: Lives of a connection's numbering: those after being forgotten begin at multiples of this.
ERA = 1 << 40


def bucket(conn: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(conn), F.lit(buckets)).cast("int")


class Connections(StatefulProcessor):
    def __init__(self, room: int, max_pending: int, connection_spans: bool, idle_ms: int):
        self.room, self.max_pending, self.connection_spans, self.idle_ms = room, max_pending, connection_spans, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "conn string", "state string")
        #: Last event of each connection: number of arrival and time in ms.
        self.last = handle.getMapState("last", "conn string", "seq long, ms long")
        self.known = handle.getValueState("known", "n long, era long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, era, timer = self.known.get() if self.known.exists() else (0, 0, 0)
        found, gone = [], []
        newest, again = 0, False
        for conn, events in pd.concat(list(rows)).drop(columns=["event_time", "bucket"]).groupby("conn", sort=True):
            there = self.states.containsKey((conn,))
            # Whether its timer came first is up to the batches: what has been idle too long is forgotten here, too.
            idle = there and int(events["ts"].min()) // 1_000_000 - self.last.getValue((conn,))[1] >= self.idle_ms
            again |= idle
            first = (era + idle) * ERA
            fresh = json.dumps({"closes": first, "sides": {}, "opens": {}}) if first else None
            assembler = assembly.Assembler(self.states.getValue((conn,))[0] if there and not idle else fresh, self.max_pending, self.connection_spans)
            found.append(assembly.walked(events, assembler))
            ms = int(events["ts"].max()) // 1_000_000
            newest = max(newest, ms)
            self.states.updateValue((conn,), (assembler.state(),))
            self.last.updateValue((conn,), (int(events["seq"].max()), ms))
            n += not there
        era += again
        if n > self.room:
            by_age = sorted((tuple(v), k[0]) for k, v in self.last.iterator())
            gone = [conn for _, conn in by_age[: n - self.room]]
            for conn in gone:
                self._forget(conn)
            n, era = self.room, era + 1
        due = max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        if not timer:
            self.handle.registerTimer(due)
            timer = due
        self.known.update((n, era, timer))
        out = pd.concat([x for x in found if len(x)]) if any(map(len, found)) else None
        if out is not None:
            yield out.astype(object).assign(evicted=None)
        if gone:
            yield pd.DataFrame({c: [None] * len(gone) for c in assembly.COLUMNS} | {"evicted": gone}, dtype=object)

    def _forget(self, conn: str) -> None:
        self.states.removeKey((conn,))
        self.last.removeKey((conn,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forget the idle; the next look is when the oldest of the others may be idle."""
        n, era, _ = self.known.get()
        now = timerValues.getCurrentWatermarkInMs()
        left = []
        idle = []
        for k, v in self.last.iterator():
            (idle if v[1] + self.idle_ms <= now else left).append((k[0], v[1]))
        for conn, _ in idle:
            self._forget(conn)
        timer = min((ms for _, ms in left), default=None)
        if timer is not None:
            self.handle.registerTimer(timer + self.idle_ms)
        # A forgotten connection may come back: its numbering starts anew then, too.
        self.known.update((n - len(idle), era + bool(idle), 0 if timer is None else timer + self.idle_ms))
        return iter(())


def bounded(events: DataFrame, max_connections: int = 100_000, buckets: int = 200, max_pending: int = assembly.MAX_PENDING, connection_spans: bool = True, idle_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """Spans of a stream of events, and rows that tell which connections were forgotten for want of room.

    Each bucket has room for max_connections / buckets of them (one at least) between batches; within
    a batch there may be more by those that it brings. Events of a connection arrive in order of seq.
    """
    timed = assembly.parsed(events).withColumn("event_time", ns_to_timestamp(F.col("ts"))).withWatermark("event_time", delay)
    processor = Connections(max(1, max_connections // buckets), max_pending, connection_spans, idle_ms)
    return timed.withColumn("bucket", bucket(F.col("conn"), buckets)).groupBy("bucket").transformWithStateInPandas(processor, ROW, "append", "eventTime")
