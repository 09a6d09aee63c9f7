"""The bound on connections: nothing changes below it; above it the oldest are forgotten, and told."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streams import batches, drained
from tracewell.operators import assembly
from tracewell.sources import adapters
from tracewell.streaming import alert_windows, connections

DDL = "seq bigint, timestamp_ns bigint, netns bigint, kind string, src_ip string, src_port int, dst_ip string, dst_port int, payload binary"
GET, OK = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n"


@pytest.fixture(scope="module", autouse=True)
def state_in_rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    alert_windows.rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, stream, **more):
    out = str(tmp_path / "out")
    drained(connections.bounded(stream, **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def test_below_the_bound_it_equals_the_batch(spark, tmp_path):
    events = adapters.tcp_events(spark, "/root/testdata/sf0.001").where("seq < 2100")
    stream = batches(spark, events, str(tmp_path / "in"), "seq", parts=3)
    # Events arrive connection by connection over a month, so that no watermark may pass.
    got = run(spark, tmp_path, stream, max_connections=10_000, buckets=3, idle_ms=10**12, delay="100 days")
    assert got.where("evicted IS NOT NULL").count() == 0
    assert sorted(map(str, got.drop("evicted").collect())) == sorted(map(str, assembly.assemble(events).collect()))


def test_more_connections_than_the_bound(spark, tmp_path):
    rng = random.Random(12)
    rows, open_ = [], []
    for k in range(600):
        if len(open_) < 40 and rng.random() < 0.5:
            port = 1000 + k
            open_.append(port)
            rows.append((k, (k + 1) * 10**6, 1, "connect", "a", port, "b", 80, b""))
        elif open_:
            port = rng.choice(open_)
            kind, payload = rng.choice([("send", GET), ("recv", OK), ("close", b"")])
            rows.append((k, (k + 1) * 10**6, 1, kind, "a", port, "b", 80, payload))
            if kind == "close" and rng.random() < 0.8:
                open_.remove(port)
    events = spark.createDataFrame(rows, DDL)
    parts, buckets, bound = 5, 2, 24
    got = run(spark, tmp_path, batches(spark, events, str(tmp_path / "in"), "seq", parts=parts), max_connections=bound, buckets=buckets, idle_ms=10**12, delay="1 day")

    # The same by hand, batch after batch.
    parsed = assembly.parsed(events).withColumn("b", connections.bucket(F.col("conn"), buckets)).toPandas().sort_values("seq")
    size, extra = divmod(len(rows), parts)
    stops = [sum(size + (j < extra) for j in range(i + 1)) for i in range(parts)]
    want, told = [], []
    for b in range(buckets):
        kept, last, era = {}, {}, 0
        for a, z in zip([0, *stops], stops):
            for conn, mine in (x for x in parsed.iloc[a:z].groupby("conn") if x[1]["b"].iloc[0] == b):
                if conn not in kept:
                    kept[conn] = assembly.Assembler(None)
                    kept[conn].closes = era * connections.ERA
                last[conn] = mine["seq"].max()
                want += list(assembly.walked(mine.drop(columns="b"), kept[conn]).itertuples(index=False, name=None))
            if len(kept) > bound // buckets:
                for conn in sorted(kept, key=last.get)[: len(kept) - bound // buckets]:
                    told.append(conn)
                    del kept[conn], last[conn]
                era += 1
    assert sorted(r.evicted for r in got.where("evicted IS NOT NULL").collect()) == sorted(told) and len(told) > 20
    spans = [tuple(r) for r in got.where("evicted IS NULL").drop("evicted").collect()]
    assert sorted(map(repr, spans)) == sorted(map(repr, want)) and len({s[1] for s in spans}) == len(spans)


def test_idle_connections_are_forgotten_by_event_time(spark, tmp_path):
    second = 10**9
    rows = [(0, second, 1, "send", "a", 1, "b", 80, GET), (1, 1 * second, 1, "send", "a", 2, "b", 80, GET)]
    rows += [(2, 25 * second, 1, "send", "a", 2, "b", 80, GET), (3, 50 * second, 1, "send", "a", 3, "b", 80, GET)]
    rows += [(4, 52 * second, 1, "recv", "a", 1, "b", 80, OK), (5, 53 * second, 1, "recv", "a", 2, "b", 80, OK)]
    stream = batches(spark, spark.createDataFrame(rows, DDL), str(tmp_path / "in"), "seq", parts=3)
    got = run(spark, tmp_path, stream, buckets=1, idle_ms=30_000, delay="0 seconds")
    # Connection 1 was idle for over 30 s, so its answer finds no request. Connection 2 was heard of in between.
    assert [(r.src_port, r.duration_us) for r in got.collect()] == [(2, 52_000_000)]
