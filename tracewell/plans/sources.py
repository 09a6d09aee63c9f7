"""Queries over capture decoding, the synthetic source and the streaming forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tracewell.operators import traces, tree
from tracewell.sources import adapters, capture, discovery, scratch, synthetic, tables
from tracewell.sources.capture_files import CaptureFiles
from tracewell.streaming import queries as streaming


def _records(spark, sf_dir):
    """Binary records made from events."""
    e = adapters.table(spark, sf_dir, "events")
    little = lambda c, size: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])
    k = F.col("event_id")
    body = F.concat(F.lit("GET /"), F.col("event_type"), F.lit(" HTTP/1.1"))
    size = F.when(k % 3 == 0, 0).otherwise(F.octet_length(body))
    addresses = F.when(k % 4 == 0, F.lit("0A0001020A000304")).otherwise(F.lit("0000000000000000"))
    text = F.concat(little(k * 1000, 8), little(F.col("user_id"), 4), little(k % 5, 4), little(k % 100, 4), addresses, little(k % 65536, 2), little(F.lit(80).cast("bigint"), 2), little(k % 6, 4), little(size.cast("bigint"), 4), F.when(size > 0, F.hex(F.encode(body, "UTF-8"))).otherwise(""))
    return e.select(k.alias("seq"), F.unhex(text).alias("record"))


def record_decode(spark, sf_dir):
    return capture.decoded(_records(spark, sf_dir)).withColumn("payload", F.decode("payload", "UTF-8"))


def capture_files(spark, sf_dir):
    """Records written to capture files and read back in pieces."""
    spark.dataSource.register(CaptureFiles)
    path = scratch.path(spark, "capture")
    _records(spark, sf_dir).select("record").write.format("capture").option("block_bytes", 65536).mode("append").save(path)
    records = spark.read.format("capture").option("max_partition_bytes", 1 << 20).load(path).select("record")
    return capture.decoded(records).withColumn("payload", F.decode("payload", "UTF-8"))


def address_fill(spark, sf_dir):
    processes = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") + 5000).alias("netns"))
    filled = capture.with_addresses(capture.decoded(_records(spark, sf_dir)))
    return capture.with_netns(filled, processes).select("seq", "pid", "netns", "src_ip", "dst_ip", "src_port")


def synthetic_requests(spark, sf_dir):
    """A synthetic request for every event."""
    return synthetic.requests_of(adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")))


def event_expansion(spark, sf_dir):
    """The seven TCP events of requests made from events."""
    k = F.col("event_id")
    requests = adapters.table(spark, sf_dir, "events").select(
        k.alias("request_id"), (F.lit(1001) + k % 3).cast("bigint").alias("client"), (F.lit(1002) + k % 3).cast("bigint").alias("server"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.lit(8001).alias("dst_port"),
        (F.lit(40000) + k % 20001).cast("int").alias("src_port"), (k * 1_000_000_000).alias("start_ns"), (F.lit(5000) + k % 100).alias("latency_us"), F.element_at(F.array(F.lit(200), F.lit(201), F.lit(500), F.lit(404)), (k % 4 + 1).cast("int")).alias("status"),
    )
    return synthetic.expanded(requests).withColumn("payload", F.decode("payload", "UTF-8"))


def mapping_file(spark, sf_dir):
    """A mapping written as JSON and read again."""
    c = adapters.table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    mapping = c.select((F.col("c_custkey") + 1000).alias("netns"), F.lit("p").alias("project_id"), F.concat(F.lit("svc_"), key).alias("service_id"), F.concat(F.lit('na"me\\n}{'), key).alias("service_name"), F.lit("production").alias("environment_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c-"), key)).otherwise("").alias("container_id"))
    path = scratch.path(spark, "services.json")
    discovery.write_mapping(mapping, path)
    return discovery.read_mapping(spark, path)


_STORES: dict[tuple[str, str], str] = {}


def _stored(spark, sf_dir):
    """Path of the stored spans of a folder's events, in two versions; made once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORES:
        path = scratch.path(spark, "spans")
        found = scratch.written(adapters.event_spans(spark, sf_dir), "event-spans")
        for k in (0, 1):
            tables.write(tables.stored_rows(found.where(F.col("span_id") % 2 == k)), path, "spans", shards=4)
        _STORES[at] = path
    return _STORES[at]


def stored_spans(spark, sf_dir):
    """Spans written by day and read back for some days."""
    found = tables.read_spans(spark, _stored(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 9))
    return found.select("trace_id", "span_id", "project_id", "http_route", "start_time", "duration_us", F.col("_date").cast("string").alias("_date"))


def _user(spark, sf_dir):
    """The trace of the user with the least id."""
    return adapters.table(spark, sf_dir, "events").agg(F.md5(F.min("user_id").cast("string"))).first()[0]


def q1_waterfall_stored(spark, sf_dir):
    """The waterfall of a trace from the files that can hold it."""
    trace = _user(spark, sf_dir)
    return traces.waterfall(tables.lookup(spark, _stored(spark, sf_dir), "spans", {"trace_id": trace}), "proj_demo", trace)


def r3_trace_detail_stored(spark, sf_dir):
    trace = _user(spark, sf_dir)
    found = traces.trace_detail(tables.lookup(spark, _stored(spark, sf_dir), "spans", {"trace_id": trace}), "proj_demo", trace)
    return found.withColumn("span_ids", F.array_join(F.transform("spans", lambda s: s["span_id"].cast("string")), ",")).drop("spans")


def retention_drop(spark, sf_dir):
    """Spans by day after the days that retention no longer keeps have been deleted."""
    path = scratch.path(spark, "retained")
    found = scratch.written(tables.stored_rows(adapters.event_spans(spark, sf_dir)), "event-spans")
    tables.write(found, path, "spans", shards=1)
    tables.drop_expired(spark, path, found.agg(F.max("start_time")).first()[0])
    return tables.read_spans(spark, path).groupBy(F.col("_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("spans"))


def trace_depths(spark, sf_dir):
    """Depth, root and critical path of every span."""
    return tree.depths(adapters.event_spans(spark, sf_dir))


def _stream(spark, sf_dir, name):
    """A table as a stream of files."""
    schema = adapters.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def stream_rollup(spark, sf_dir):
    """The streaming roll-up of root spans, run to the end of what is there; closed windows only."""

    root = scratch.path(spark, "stream")
    e = _stream(spark, sf_dir, "events")
    spans = e.select(
        F.lit("proj_demo").alias("project_id"), F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("service_id"), F.lit("production").alias("environment_id"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/:id")).alias("http_route"), F.lit("GET").alias("http_method"), F.col("ts").cast("timestamp").alias("start_time"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_us"), (F.col("event_type") == "error").alias("is_error"),
    )
    query = streaming.rollup_stream(spans).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("sketch")


RECORD = """SELECT event_id AS seq, event_id * 1000 AS timestamp_ns, user_id AS pid, event_id % 5 AS netns, event_id % 100 AS fd, event_id % 65536 AS src_port, CAST(80 AS BIGINT) AS dst_port,
    CASE WHEN event_id % 4 = 0 THEN '10.0.1.2' ELSE '0.0.0.0' END AS src_ip, CASE WHEN event_id % 4 = 0 THEN '10.0.3.4' ELSE '0.0.0.0' END AS dst_ip,
    CASE event_id % 6 WHEN 0 THEN 'connect' WHEN 1 THEN 'accept' WHEN 2 THEN 'send' WHEN 3 THEN 'recv' ELSE 'close' END AS kind,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'GET /' || event_type || ' HTTP/1.1' END AS payload FROM events"""
EVENT_SPANS = """WITH n AS (SELECT *, row_number() OVER own AS k, lag(event_id, 1) OVER own AS p1, lag(event_id, 2) OVER own AS p2, lag(event_id, 3) OVER own AS p3 FROM events WINDOW own AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT md5(CAST(user_id AS VARCHAR)) AS trace_id, event_id + 1 AS span_id, coalesce(CASE least(k - 1, 1 + event_id % 3) WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 END + 1, 0) AS parent_span_id,
        'proj_demo' AS project_id, 'svc_' || (user_id % 4) AS service_id, 'GET' AS http_method, '/' || event_type || '/' || event_id AS http_path, '/' || event_type || '/:id' AS http_route,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, ts AS start_time, CAST(floor(value * 1000) AS BIGINT) AS duration_us, event_type = 'error' AS is_error, event_id + 1 AS arrival_seq FROM n)"""
SQL = {
    "record_decode": RECORD,
    "capture_files": f"SELECT * EXCLUDE (seq) FROM ({RECORD})",
    "address_fill": f"""WITH r AS ({RECORD}), f AS (SELECT *, last_value(CASE WHEN src_ip <> '0.0.0.0' THEN src_port END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM r)
        SELECT seq, pid, CASE WHEN netns <> 0 THEN netns ELSE coalesce(c_custkey + 5000, 0) END AS netns, CASE WHEN src_ip = '0.0.0.0' AND payload <> '' AND p IS NOT NULL THEN '10.0.1.2' ELSE src_ip END AS src_ip,
            CASE WHEN src_ip = '0.0.0.0' AND payload <> '' AND p IS NOT NULL THEN '10.0.3.4' ELSE dst_ip END AS dst_ip, CASE WHEN src_ip = '0.0.0.0' AND payload <> '' AND p IS NOT NULL THEN p ELSE src_port END AS src_port
        FROM f LEFT JOIN customer ON pid = c_custkey""",
    "event_expansion": """WITH r AS (SELECT event_id AS id, 1001 + event_id % 3 AS client, 1002 + event_id % 3 AS server, 5000 + event_id % 100 AS latency,
            CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END || ' /' || event_type || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || ['user-service', 'payment-service', 'db-service'][event_id % 3 + 1] || ':8001' || chr(13) || chr(10) || chr(13) || chr(10) AS ask,
            'HTTP/1.1 ' || ['200 OK', '201 Created', '500 Internal Server Error', '404 Unknown'][event_id % 4 + 1] || chr(13) || chr(10) || 'Content-Length: 0' || chr(13) || chr(10) || chr(13) || chr(10) AS answer FROM events),
        s(k, kind, side, off_us, late, what) AS (VALUES (0, 'connect', 'c', 0, 0, ''), (1, 'accept', 's', 100, 0, ''), (2, 'send', 'c', 200, 0, 'a'), (3, 'recv', 's', 300, 0, 'a'), (4, 'send', 's', -200, 1, 'b'), (5, 'recv', 'c', -100, 1, 'b'), (6, 'close', 'c', 0, 1, ''))
        SELECT id * 7 + k AS seq, CAST(id * 1000000000 + (off_us + late * latency) * 1000 AS BIGINT) AS timestamp_ns, CAST(CASE side WHEN 'c' THEN client ELSE server END AS BIGINT) AS netns, kind, '172.17.0.' || (client - 999) AS src_ip, CAST(40000 + id % 20001 AS INTEGER) AS src_port,
            '172.17.0.' || (server - 999) AS dst_ip, CAST(8001 AS INTEGER) AS dst_port, CASE what WHEN 'a' THEN ask WHEN 'b' THEN answer ELSE '' END AS payload FROM r, s""",
    "mapping_file": """SELECT c_custkey + 1000 AS netns, 'p' AS project_id, 'svc_' || c_custkey AS service_id, 'na"me' || chr(92) || 'n}{' || c_custkey AS service_name, 'production' AS environment_id, CASE WHEN c_custkey % 2 = 0 THEN 'c-' || c_custkey ELSE '' END AS container_id FROM customer""",
    "stored_spans": f"""{EVENT_SPANS} SELECT trace_id, span_id, project_id, http_route, start_time, duration_us, CAST(CAST(start_time AS DATE) AS VARCHAR) AS _date FROM s
        WHERE start_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'""",
    "q1_waterfall_stored": f"{EVENT_SPANS} SELECT {', '.join(traces.WATERFALL)} FROM s WHERE trace_id = (SELECT md5(CAST(min(user_id) AS VARCHAR)) FROM events)",
    "r3_trace_detail_stored": f"""{EVENT_SPANS} SELECT trace_id, max(duration_us) AS total_duration_us, count(*) AS span_count, bool_or(is_error) AS has_error, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY arrival_seq) AS span_ids
        FROM s WHERE trace_id = (SELECT md5(CAST(min(user_id) AS VARCHAR)) FROM events) GROUP BY trace_id""",
    "retention_drop": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS spans FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 7 FROM events) GROUP BY 1""",
    "trace_depths": f"""{EVENT_SPANS.replace("WITH ", "WITH RECURSIVE ", 1)}, last AS (SELECT trace_id, parent_span_id AS parent, arg_max(span_id, (epoch_us(start_time) + duration_us, -span_id)) AS child FROM s WHERE parent_span_id <> 0 GROUP BY ALL),
        w AS (SELECT trace_id, span_id, CAST(0 AS BIGINT) AS depth, span_id AS root_id, true AS critical FROM s WHERE parent_span_id = 0
            UNION ALL SELECT s.trace_id, s.span_id, w.depth + 1, w.root_id, w.critical AND s.span_id = last.child FROM w JOIN s ON s.trace_id = w.trace_id AND s.parent_span_id = w.span_id JOIN last ON last.trace_id = w.trace_id AND last.parent = w.span_id)
        SELECT trace_id, span_id, depth, root_id, critical FROM w""",
}
QUERIES = {f.__name__: f for f in (record_decode, capture_files, address_fill, synthetic_requests, event_expansion, mapping_file, stored_spans, q1_waterfall_stored, r3_trace_detail_stored, retention_drop, trace_depths, stream_rollup)}
