"""Span assembly: the scripted cases, and the two forms against each other on random events."""

import random

import pyarrow as pa
import pytest

from tracewell.operators import assembly
from tracewell.sources import adapters

DDL = "seq bigint, timestamp_ns bigint, netns bigint, kind string, src_ip string, src_port int, dst_ip string, dst_port int, payload binary"
GET = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n"
OK = b"HTTP/1.1 200 OK\r\n\r\n"


def events(spark, rows):
    full = [(k, ts, ns, kind, "10.0.0.1", port, "10.0.0.2", 80, payload) for k, (ts, ns, kind, port, payload) in enumerate(rows)]
    return spark.createDataFrame(full, DDL)


def spans(spark, rows, **more):
    return sorted(assembly.assemble(events(spark, rows), **more).collect(), key=lambda r: (r.start_time_ns, r.netns))


def test_client_request_and_answer(spark):
    (s,) = spans(spark, [(1_000_000, 1001, "connect", 5, b""), (1_100_000, 1001, "send", 5, GET), (1_500_000, 1001, "recv", 5, OK)])
    assert (s.duration_us, s.http_status, s.is_error, s.http_path, s.http_host, s.is_root) == (400, 200, False, "/a", "h", True)


def test_pipelined_requests_answer_in_order(spark):
    second = GET.replace(b"/a", b"/b")
    a, b = spans(spark, [(0, 1, "send", 5, GET), (100_000, 1, "send", 5, second), (500_000, 1, "recv", 5, OK), (800_000, 1, "recv", 5, OK)])
    assert [(a.http_path, a.duration_us), (b.http_path, b.duration_us)] == [("/a", 500), ("/b", 700)]


def test_close_gives_waiting_requests_and_bare_connections(spark):
    (s,) = spans(spark, [(0, 1, "send", 5, GET), (700_000, 1, "close", 5, b"")])
    assert (s.http_status, s.is_error, s.duration_us) == (0, False, 700)
    (t,) = spans(spark, [(0, 1, "connect", 5, b""), (900_000, 1, "close", 5, b"")])
    assert (t.http_method, t.http_path, t.duration_us, t.is_root) == ("TCP", "10.0.0.2:80", 900, True)
    assert spans(spark, [(0, 1, "connect", 5, b""), (9, 1, "close", 5, b"")], connection_spans=False) == []


def test_same_host_and_traceparent(spark):
    client, server = spans(spark, [(0, 1, "send", 5, GET), (100_000, 2, "recv", 5, GET), (200_000, 2, "send", 5, OK), (300_000, 1, "recv", 5, OK)])
    assert server.trace_id == client.trace_id and server.parent_span_id == client.span_id and not server.is_root
    given = GET.replace(b"Host", b"traceparent: 00-" + b"ab" * 16 + b"-00000000000000ff-01\r\nHost")
    (s,) = spans(spark, [(0, 2, "recv", 5, given), (9, 2, "send", 5, OK)])
    assert (s.trace_id, s.parent_span_id) == ("ab" * 16, 255)


def test_reset_forgets_and_noise_is_skipped(spark):
    assert spans(spark, [(0, 1, "send", 5, GET), (1, 1, "connect", 5, b""), (2, 1, "recv", 5, OK)]) == []
    assert spans(spark, [(0, 1, "send", 5, b"\x16\x03\x01\x00"), (1, 1, "recv", 5, b""), (2, 1, "recv", 5, OK)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_forms_agree_on_random_events(spark, seed):
    """All columns, trace and parent ids too: two or three namespaces, both roles on a side, more waiting than the cap."""
    rng = random.Random(seed)
    given = GET.replace(b"Host", b"TraceParent: 00-" + b"ab" * 16 + b"-00000000000000ff-01\r\nHost")
    rows = []
    for k in range(1500):
        kind = rng.choice(["connect", "accept", "send", "recv", "send", "recv", "send", "recv", "close"] if rng.random() < 0.4 else ["send", "recv"])
        port, ns = rng.randint(1, 40), rng.choice([1, 2, 10])
        payload = b"" if kind not in ("send", "recv") else rng.choice([GET, OK, GET, OK, b"", b"junk", b"GET broken", given])
        if port < 20:  # usual ones: namespace 1 asks and namespace 2 answers
            ns = 1 if ns == 1 else 2
            if kind in ("send", "recv") and payload in (GET, OK, given):
                kind = {(1, True): "send", (2, True): "recv", (1, False): "recv", (2, False): "send"}[ns, payload != OK]
        rows.append((k * 1000, ns, kind, port, payload))
    df = events(spark, rows)
    cap = 3 if seed % 2 else 64
    whole = [tuple(r) for r in assembly.assemble(df, max_pending=cap).collect()]
    walked = [tuple(r) for r in assembly.assemble_stateful(df, max_pending=cap).collect()]
    assert sorted(whole) == sorted(walked) and whole
    odd = {r.conn: r.odd for r in assembly._counted(assembly.parsed(df), cap).select("conn", "odd").distinct().collect()}
    assert set(odd.values()) == {True, False}


def test_parts_grow_with_the_events(spark, monkeypatch):
    """A task holds some PART_EVENTS events whatever the batch; also of those that are walked."""
    monkeypatch.setattr(assembly, "PART_EVENTS", 50)
    rows = [(10 * k + i, 1 + i % 2, ("send", "recv", "send", "recv")[i], k, GET if i < 2 else OK) for k in range(200) for i in range(4)]
    df = events(spark, rows)
    whole, walked = assembly.assemble(df), assembly.assemble_stateful(df)
    assert walked.rdd.getNumPartitions() == 16 and len(whole.inputFiles()) == 16
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, walked.collect())) and whole.count() == 400
    monkeypatch.setattr(assembly, "PART_EVENTS", 800)
    assert assembly.assemble_stateful(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("values, kind", [([1, None, -(2**62) - 1], "int64"), ([None, "a"], "string"), ([3, 2**62 + 1], "int64"), ([None, True], "bool_"), ([None, None], "int32")])
def test_listed_equals_to_pylist(values, kind):
    column = pa.array(values, getattr(pa, kind)())
    assert assembly._listed(column) == column.to_pylist()


def test_cap_drops_the_oldest(spark):
    rows = [(k, 1, "send", 5, GET.replace(b"/a", b"/%d" % k)) for k in range(4)] + [(10, 1, "recv", 5, OK)]
    for form in (assembly.assemble, assembly.assemble_stateful):
        (s,) = form(events(spark, rows), max_pending=2).collect()
        assert s.http_path == "/2"


def test_seventy_open_requests_leave_the_newest_64(spark):
    rows = [(k, 1, "send", 5, GET.replace(b"/a", b"/%d" % k)) for k in range(70)] + [(1000, 1, "close", 5, b"")]
    assert sorted(int(s.http_path[1:]) for s in spans(spark, rows)) == list(range(6, 70))


def test_nulls(spark):
    """A null namespace is 0, null addresses are equal, null payloads are empty, and other kinds mean nothing."""
    rows = [(0, 0, None, "send", None, None, None, None, GET), (1, 500_000, 0, "recv", None, None, None, None, OK), (2, 1, 1, "send", None, None, None, None, None), (3, 1, 1, None, "a", 1, "b", 2, GET), (4, 9, 1, "odd", "a", 1, "b", 2, GET)]
    df = spark.createDataFrame(rows, DDL)
    for form in (assembly.assemble, assembly.assemble_stateful):
        (s,) = form(df).collect()
        assert (s.netns, s.duration_us, s.http_status) == (0, 500, 200)


def test_no_events_give_no_spans(spark):
    assert assembly.assemble(events(spark, [(0, 1, "send", 5, GET)]).limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from tracewell.streaming import queries as streaming

    batch = adapters.tcp_events(spark, "/root/testdata/sf0.001").where("seq < 1600")
    source = str(tmp_path / "in")
    batch.repartition(1).sortWithinPartitions("seq").write.parquet(source)
    stream = streaming.assembled(spark.readStream.schema(batch.schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("span_id", "trace_id", "duration_us").collect()))
    assert got == sorted(map(tuple, assembly.assemble(batch).select("span_id", "trace_id", "duration_us").collect()))
