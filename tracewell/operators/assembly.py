"""HTTP spans from TCP events.

The window form is one plan of window functions over one shuffle by connection: requests and
responses of a side (a namespace of a 4-tuple) are numbered, a response answers the oldest open
request, and running minima tell responses that answer nothing. What a server's request is part
of follows from the other side's counters at that moment, without a join.

Three kinds of connections need more than counters: those on which more requests wait than the
cap (the oldest are forgotten), those of three or more namespaces, and those on which a side both
takes and sends requests (contexts pass on in turn). The window form finds them, and their events
are walked one by one in arrival order, in state of one connection at a time. The same walk
serves streams.

Ids come from the connection and the request's number, so that retried tasks make the same.
A connection's life ends at a close of its 4-tuple (on every namespace); connect and accept
begin it anew and forget what was open. Where several other namespaces have a waiting request, a
server's request belongs to the newest of the lowest namespace.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import http
from tracewell.functions.spans import derived_span_id, derived_trace_id, ns_to_timestamp
from tracewell.sources.scratch import written

SPAN_ROW = (
    "trace_id string, span_id bigint, parent_span_id bigint, netns bigint, http_method string, http_path string, http_host string, http_status int, "
    "start_time_ns bigint, duration_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, is_error boolean, is_root boolean"
)
COLUMNS = [x.split()[0] for x in SPAN_ROW.split(", ")]

MAX_PENDING = 64  # requests of a side that may wait
PART_EVENTS = 200_000  # events that a task holds about, so that its sorts don't grow with the batch


def parts_of(events: DataFrame) -> int:
    """In how many parts a batch is dealt by connection; one pass counts its events."""
    return max(events.sparkSession.sparkContext.defaultParallelism, math.ceil(events.count() / PART_EVENTS))


def parsed(events: DataFrame, *more: str, parts: int | None = None) -> DataFrame:
    """What assembly reads of each event: requests, responses, and whether it makes the connection known.

    Each step is read more than once by the next, so that no text is worked out twice. more: columns of events that pass through.
    A null namespace is 0; null addresses are one with each other; an unknown or null kind is an event without meaning.
    parts: the events are dealt by connection into so many before any text is read.
    """
    p = F.col("payload")
    data = F.col("kind").isin("send", "recv")
    empty = F.coalesce(F.octet_length(p), F.lit(0)) == 0
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conn = F.concat(shown("src_ip"), F.lit(":"), shown("src_port"), F.lit(">"), shown("dst_ip"), F.lit(":"), shown("dst_port"))
    events = events.withColumns({"netns": F.coalesce("netns", F.lit(0).cast("bigint")), "conn": conn})
    if parts is not None:
        events = events.select("seq", "timestamp_ns", "netns", "kind", "src_ip", "src_port", "dst_ip", "dst_port", "payload", "conn", *more).repartition(parts, "conn")
    # Payloads that can't be HTTP are never decoded.
    out = events.select("seq", F.col("timestamp_ns").alias("ts"), "netns", "kind", "src_ip", "src_port", "dst_ip", "dst_port", "payload", "conn", F.when(data & http.passes_prefilter(p), http.latin(p)).alias("t"), (data & empty).alias("blank"), *more)
    asks, answers = F.col("t").rlike(http.REQUEST_PREFIX), F.col("t").startswith("HTTP/")
    line = F.try_validate_utf8(F.substring(p, F.lit(1), F.col("at") - 1).cast("string"))
    out = out.withColumns({"at": F.locate("\r\n", F.col("t")), "asks": F.coalesce(asks, F.lit(False)), "answers": F.coalesce(answers, F.lit(False))})
    out = out.withColumn("parts", F.split(F.when((F.col("at") > 0) & (F.col("asks") | F.col("answers")), line), " ", 3))
    whole = F.col("asks") & (F.size("parts") == 3)
    status = F.when(F.col("answers") & (F.size("parts") >= 2) & F.try_element_at("parts", F.lit(2)).rlike("^[+]?[0-9]{1,9}$"), F.try_element_at("parts", F.lit(2)).try_cast("int"))
    out = out.withColumns({"is_req": F.coalesce(whole, F.lit(False)), "code": F.when(status.between(100, 599), status)})
    out = out.withColumn("tp", F.when(F.col("is_req"), http.parse_traceparent(http.header_value(F.col("t"), "traceparent"))))
    known = F.col("kind").isin("connect", "accept") | F.col("blank") | F.col("is_req")
    of_request = lambda c: F.when(F.col("is_req"), c)
    return out.select(
        "seq", "ts", "netns", "kind", "src_ip", "src_port", "dst_ip", "dst_port", "conn",
        F.col("is_req").cast("int").alias("req"), F.col("code").isNotNull().cast("int").alias("resp"), known.cast("int").alias("registers"),
        of_request(F.try_element_at("parts", F.lit(1))).alias("method"), of_request(F.try_element_at("parts", F.lit(2))).alias("path"),
        of_request(F.coalesce(http.header_value(F.col("t"), "host"), F.lit(""))).alias("host"),
        F.col("code").alias("status"), F.col("tp.trace_id").alias("tp_trace"), http.hex_to_long(F.col("tp.parent_hex")).alias("tp_parent"), *more,
    )


def _counted(events: DataFrame, max_pending: int) -> DataFrame:
    """Parsed events with the counters of their side, what waits on the other, and odd: whether the connection is walked."""
    first, now = Window.unboundedPreceding, Window.currentRow
    of = lambda *keys: Window.partitionBy("conn", *keys)
    running = lambda *keys: of(*keys).orderBy("seq").rowsBetween(first, now)
    out = events.withColumn("closes", F.coalesce(F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).over(of().orderBy("seq").rowsBetween(first, -1)), F.lit(0)))
    out = out.withColumn("opens", F.sum(F.when(F.col("kind").isin("connect", "accept"), 1).otherwise(0)).over(running("netns", "closes")))
    side, life = ("netns", "closes"), ("netns", "closes", "opens")
    out = out.withColumns({"final": F.max("opens").over(of(*side)), "is_last": F.lead("seq").over(of(*side).orderBy("seq")).isNull()})
    out = out.withColumns({
        "nreq": F.sum("req").over(running(*life)), "nresp": F.sum("resp").over(running(*life)),
        "begun": F.min(F.when(F.col("registers") == 1, F.col("ts"))).over(running(*life)),
        "last_tp": F.last(F.when(F.col("req") == 1, F.struct("tp_trace")), ignorenulls=True).over(running(*life)),
    })
    open_now = F.col("nreq") - F.col("nresp")
    least = lambda w: F.least(F.lit(0), F.coalesce(F.min(open_now).over(w), F.lit(0)))
    out = out.withColumns({"low": least(running(*life)), "low_before": least(of(*life).orderBy("seq").rowsBetween(first, -1))})
    out = out.withColumn("pending", open_now - F.col("low"))
    out = out.withColumns({"lo": F.min("netns").over(of()), "hi": F.max("netns").over(of())})
    # The newest request of each of two sides that waits at this moment.
    newest = F.struct("opens", F.col("nreq").alias("n"), "pending", F.col("last_tp.tp_trace").alias("tp_trace"))
    out = out.withColumns({x: F.last(F.when(F.col("netns") == F.col(x), newest), ignorenulls=True).over(running("closes")) for x in ("lo", "hi")} | {"lo_ns": F.col("lo"), "hi_ns": F.col("hi"), "close_ts": F.max(F.when(F.col("kind") == "close", F.col("ts"))).over(of("closes"))})
    takes, sends = ((F.col("req") == 1) & (F.col("kind") == k) for k in ("recv", "send"))
    low_side = F.col("netns") == F.col("lo_ns")
    some = lambda c: F.max(c.cast("int")).over(of()) == 1
    both = (some(takes & low_side) & (some(sends & low_side) | some(takes & ~low_side))) | (some(takes & ~low_side) & some(sends & ~low_side))
    return out.withColumn("odd", both | some(F.col("pending") > max_pending) | some(~F.col("netns").isin(F.col("lo_ns"), F.col("hi_ns"))))


def _entries(counted: DataFrame) -> DataFrame:
    """One row per request with its answer, per end of a side's life (n = -1), and per event of an odd connection (n = -2)."""
    answers = (F.col("resp") == 1) & (F.col("low") == F.col("low_before"))
    kinds = F.array(
        F.when(~F.col("odd") & (F.col("req") == 1), F.col("nreq")),
        F.when(~F.col("odd") & answers, F.col("nresp") + F.col("low")),
        F.when(~F.col("odd") & F.col("is_last"), F.lit(-1).cast("bigint")),
        F.when(F.col("odd"), F.lit(-2).cast("bigint")),
    )
    peer = F.when(F.col("netns") == F.col("lo_ns"), F.col("hi")).otherwise(F.col("lo"))
    peer_ns = F.when(F.col("lo_ns") != F.col("hi_ns"), F.when(F.col("netns") == F.col("lo_ns"), F.col("hi_ns")).otherwise(F.col("lo_ns")))
    found = (F.col("req") == 1) & (F.col("kind") == "recv") & peer_ns.isNotNull() & (peer["pending"] > 0)
    parent = F.when(found, F.struct(peer_ns.alias("netns"), peer["opens"].alias("opens"), peer["n"].alias("n"), peer["tp_trace"].alias("tp_trace")))
    event = [F.col(c) for c in EVENT]
    return counted.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("n"), *event, "closes", "opens", "final", "pending", "begun", "close_ts", parent.alias("peer"))


EVENT = ["seq", "ts", "netns", "kind", "src_ip", "src_port", "dst_ip", "dst_port", "conn", "req", "resp", "registers", "method", "path", "host", "status", "tp_trace", "tp_parent"]


def _cause(netns: Column, opens: Column, last: Column) -> list[Column]:
    return [F.col("conn"), netns.cast("string"), F.col("closes").cast("string"), opens.cast("string"), last.cast("string")]


def _spans(pairs: DataFrame, connection_spans: bool) -> DataFrame:
    """Spans of the paired entries: answered requests, those that wait at a close, and closed sides without any."""
    request, answer = F.col("r"), F.col("a")
    asked = (F.col("n") > 0) & request.isNotNull()
    waits = asked & answer.isNull() & (F.col("opens") == request["final"]) & request["close_ts"].isNotNull()
    bare = (F.col("n") == -1) & (answer["pending"] == 0) & answer["begun"].isNotNull() & answer["close_ts"].isNotNull() & F.lit(connection_spans)
    rows = pairs.where((asked & answer.isNotNull()) | waits | bare)
    tcp = F.col("n") == -1
    last = F.when(tcp, F.lit("tcp")).otherwise(F.col("n").cast("string"))
    own, peer = _cause(F.col("netns"), F.col("opens"), last), request["peer"]
    theirs = _cause(peer["netns"], peer["opens"], peer["n"])
    trace = F.coalesce(request["tp_trace"], peer["tp_trace"], F.when(peer.isNotNull(), derived_trace_id(F.lit("trace"), *theirs)), derived_trace_id(F.lit("trace"), *own))
    parent = F.when(request["tp_trace"].isNotNull(), request["tp_parent"]).when(peer.isNotNull(), derived_span_id(F.lit("span"), *theirs)).otherwise(F.lit(0).cast("bigint"))
    where = F.concat(F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"))
    start = F.when(tcp, answer["begun"]).otherwise(request["ts"])
    end = F.when(tcp, answer["close_ts"]).when(answer.isNull(), request["close_ts"]).otherwise(answer["ts"])
    shown = rows.select(
        trace.alias("trace_id"), derived_span_id(F.lit("span"), *own).alias("span_id"), parent.alias("parent_span_id"), "netns",
        F.when(tcp, "TCP").otherwise(request["method"]).alias("http_method"), F.when(tcp, where).otherwise(request["path"]).alias("http_path"), F.when(tcp, where).otherwise(request["host"]).alias("http_host"),
        F.when(tcp | answer.isNull(), 0).otherwise(answer["status"]).alias("http_status"),
        start.alias("start"), end.alias("end"), F.greatest(F.floor((end - start) / 1000), F.lit(0)).cast("bigint").alias("duration_us"), "src_ip", "src_port", "dst_ip", "dst_port",
    )
    begin = F.when(F.col("http_method") == "TCP", F.col("end") - F.col("duration_us") * 1000).otherwise(F.col("start"))
    return shown.withColumns({"start_time_ns": begin, "is_error": F.col("http_status") >= 400, "is_root": F.col("parent_span_id") == 0}).select(*COLUMNS)


def assemble(events: DataFrame, connection_spans: bool = True, max_pending: int = MAX_PENDING) -> DataFrame:
    """Spans of a batch of events. connection_spans: also one TCP span for each side of a closed
    connection on which nothing waits.

    The paired entries are a table: spans and the events to walk are both read from it.
    """
    parts = parts_of(events)
    entries = _entries(_counted(parsed(events, parts=parts), max_pending))
    keys = ["conn", "netns", "closes", "opens", "n", F.when(F.col("n") == -2, F.col("seq")).alias("one")]
    asks = F.struct("ts", "tp_trace", "tp_parent", "method", "path", "host", "final", "close_ts", "peer")
    answer = F.struct("ts", "status", "pending", "begun", "close_ts")
    pairs = entries.groupBy(*keys).agg(
        F.max(F.when((F.col("n") > 0) & (F.col("req") == 1), asks)).alias("r"), F.max(F.when((F.col("n") == -1) | ((F.col("n") > 0) & (F.col("resp") == 1)), answer)).alias("a"),
        F.first("src_ip").alias("src_ip"), F.first("src_port").alias("src_port"), F.first("dst_ip").alias("dst_ip"), F.first("dst_port").alias("dst_port"),
        F.max(F.when(F.col("n") == -2, F.struct(*EVENT))).alias("event"),
    )
    pairs = written(pairs, "assembly")
    return _spans(pairs.where("n > -2"), connection_spans).unionByName(_walk(pairs.where("n = -2").select("event.*").repartition(parts, "conn"), max_pending, connection_spans))


def _walk(rows: DataFrame, max_pending: int, connection_spans: bool) -> DataFrame:
    """Spans of parsed events that are dealt by connection, walked in arrival order; a task holds the state of one connection at a time."""
    rows = rows.sortWithinPartitions("conn", "seq").drop("seq")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, assembler = None, None
        for batch in batches:
            found = []
            for e in (dict(zip(names, row)) for row in zip(*map(_listed, batch.columns))):
                if e["conn"] != last:
                    last, assembler = e["conn"], Assembler(None, max_pending, connection_spans)
                found += assembler.process(e)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * len(KINDS), KINDS)], COLUMNS)

    return rows.mapInArrow(run, SPAN_ROW)


def _listed(column: pa.Array) -> list:
    """to_pylist without an Arrow scalar for each value."""
    if not column.null_count or pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_integer(column.type):
        return column.to_pylist()
    there = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [x if ok else None for x, ok in zip(column.fill_null(0).to_numpy(zero_copy_only=False).tolist(), there)]


#: Arrow kinds of SPAN_ROW.
KINDS = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in SPAN_ROW.split(", ")]


def side_counters(events: DataFrame) -> DataFrame:
    """Of each namespace: events, requests, responses, skipped (payloads that are neither), empty ones, and payload bytes sent and received."""
    read = parsed(events.withColumn("size", F.octet_length("payload")), "size")
    data = F.col("kind").isin("send", "recv")
    size = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    return read.groupBy("netns").agg(
        F.count(F.lit(1)).alias("events"), F.sum("req").alias("requests"), F.sum("resp").alias("responses"),
        F.count_if(data & (size > 0) & (F.col("req") + F.col("resp") == 0)).alias("skipped"), F.count_if(data & (size == 0)).alias("empty"),
        F.sum(F.when(F.col("kind") == "send", size).otherwise(0)).alias("bytes_sent"), F.sum(F.when(F.col("kind") == "recv", size).otherwise(0)).alias("bytes_received"),
    )


class Assembler:
    """The stateful form, for the events of one 4-tuple in arrival order."""

    def __init__(self, state: str | None = None, max_pending: int = MAX_PENDING, connection_spans: bool = True):
        loaded = json.loads(state) if state else {"closes": 0, "sides": {}, "opens": {}}
        self.closes, self.sides, self.opens = loaded["closes"], loaded["sides"], loaded["opens"]
        self.max_pending, self.connection_spans = max_pending, connection_spans

    def state(self) -> str:
        return json.dumps({"closes": self.closes, "sides": self.sides, "opens": self.opens})

    def _side(self, e: dict) -> dict:
        key = str(e["netns"])
        return self.sides.setdefault(key, {"begin": e["ts"], "n": 0, "pending": [], "context": None})

    def process(self, e: dict) -> list[tuple]:
        key = str(e["netns"])
        if e["kind"] in ("connect", "accept"):
            self.opens[key] = self.opens.get(key, 0) + 1
            self.sides[key] = {"begin": e["ts"], "n": 0, "pending": [], "context": None}
        elif e["kind"] == "close":
            return self._close(e)
        elif e["req"]:
            self._request(e, key)
        elif e["resp"]:
            side = self.sides.get(key)
            if side and side["pending"]:
                return [self._span(e, e["netns"], side["pending"].pop(0), int(e["status"]), e["ts"])]
        elif e["registers"]:
            self._side(e)
        return []

    def _request(self, e: dict, key: str) -> None:
        side = self._side(e)
        side["n"] += 1
        cause = f"{e['conn']}|{key}|{self.closes}|{self.opens.get(key, 0)}|{side['n']}"
        span_id = int(hashlib.md5(f"span|{cause}".encode()).hexdigest()[:15], 16)
        trace, parent = hashlib.md5(f"trace|{cause}".encode()).hexdigest(), 0
        if e["tp_trace"]:
            trace, parent = e["tp_trace"], int(e["tp_parent"])
        elif e["kind"] == "recv":
            other = next((s["pending"][-1] for k, s in sorted(self.sides.items(), key=lambda x: int(x[0])) if k != key and s["pending"]), None)
            if other:
                trace, parent = other["trace"], other["span"]
        elif side["context"]:
            trace, parent = side["context"]
        if e["kind"] == "recv":
            side["context"] = [trace, span_id]
        if len(side["pending"]) >= self.max_pending:
            side["pending"].pop(0)
        side["pending"].append({"trace": trace, "span": span_id, "parent": parent, "method": e["method"], "path": e["path"], "host": e["host"], "ts": e["ts"]})

    def _close(self, e: dict) -> list[tuple]:
        out = []
        for key, side in sorted(self.sides.items()):
            for p in side["pending"]:
                out.append(self._span(e, int(key), p, 0, e["ts"]))
            if not side["pending"] and self.connection_spans:
                cause = f"{e['conn']}|{key}|{self.closes}|{self.opens.get(key, 0)}|tcp"
                where = f"{e['dst_ip']}:{e['dst_port']}"
                took = max(0, e["ts"] - side["begin"]) // 1000
                p = {"trace": hashlib.md5(f"trace|{cause}".encode()).hexdigest(), "span": int(hashlib.md5(f"span|{cause}".encode()).hexdigest()[:15], 16), "parent": 0, "method": "TCP", "path": where, "host": where, "ts": e["ts"] - took * 1000}
                out.append(self._span(e, int(key), p, 0, e["ts"]))
        self.closes, self.sides, self.opens = self.closes + 1, {}, {}
        return out

    def _span(self, e: dict, netns: int, p: dict, status: int, end: int) -> tuple:
        return (p["trace"], p["span"], p["parent"], netns, p["method"], p["path"], p["host"], status, p["ts"], max(0, end - p["ts"]) // 1000, e["src_ip"], e["src_port"], e["dst_ip"], e["dst_port"], status >= 400, p["parent"] == 0)


def walked(rows: pd.DataFrame, assembler: Assembler) -> pd.DataFrame:
    found = [s for e in rows.sort_values("seq").astype(object).where(lambda x: x.notna(), None).to_dict("records") for s in assembler.process(e)]
    return pd.DataFrame(found, columns=COLUMNS)


def assemble_stateful(events: DataFrame, max_pending: int = MAX_PENDING, connection_spans: bool = True) -> DataFrame:
    """Spans of a batch by the walk alone."""
    return _walk(parsed(events, parts=parts_of(events)), max_pending, connection_spans)


def assemble_stream(events: DataFrame, max_pending: int = MAX_PENDING, connection_spans: bool = True, idle_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """Spans of a stream of events; a 4-tuple's state goes once event time is idle_ms past its last event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        assembler = Assembler(state.get[0] if state.exists else None, max_pending, connection_spans)
        rows = pd.concat(list(frames)).drop(columns="event_time")
        yield walked(rows, assembler)
        # Kept after a close too: the number of closes keeps later ids apart.
        state.update((assembler.state(),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max()) // 1_000_000, state.getCurrentWatermarkMs()) + idle_ms)

    timed = parsed(events).withColumn("event_time", ns_to_timestamp(F.col("ts"))).withWatermark("event_time", delay)
    return timed.groupBy("conn").applyInPandasWithState(step, SPAN_ROW, "state string", "append", "EventTimeTimeout")
