"""Queries over span assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import assembly
from tracewell.sources import adapters, discovery


def span_assembly(spark, sf_dir):
    return assembly.assemble(adapters.tcp_events(spark, sf_dir))


def span_assembly_strict(spark, sf_dir):
    return assembly.assemble(adapters.tcp_events(spark, sf_dir), connection_spans=False)


def span_assembly_incomplete(spark, sf_dir):
    return assembly.assemble(adapters.tcp_events(spark, sf_dir)).where("http_status = 0 AND http_method <> 'TCP'")


def span_assembly_stateful(spark, sf_dir):
    return assembly.assemble_stateful(adapters.tcp_events(spark, sf_dir))


def same_host_correlation(spark, sf_dir):
    spans = assembly.assemble(adapters.tcp_events(spark, sf_dir), connection_spans=False)
    parent = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("p"), F.col("netns").alias("parent_netns"))
    return spans.join(parent, (F.col("trace_id") == F.col("t")) & (F.col("parent_span_id") == F.col("p"))).select("trace_id", "span_id", "netns", "parent_netns", "http_path")


def span_assembly_unusual(spark, sf_dir):
    """Connections over the cap, of three namespaces, and with chained contexts."""
    return assembly.assemble(adapters.unusual_events(spark, sf_dir), connection_spans=False)


def assembly_counters(spark, sf_dir):
    """What was read, skipped and counted of each side, bytes included."""
    return assembly.side_counters(adapters.tcp_events(spark, sf_dir))


def assembled_services(spark, sf_dir):
    """Assembled spans with their services, unknown namespaces included."""
    return discovery.enriched(assembly.assemble(adapters.tcp_events(spark, sf_dir)), adapters.mapping(spark)).groupBy("service_id", "container_id", "http_method").agg(F.count(F.lit(1)).alias("spans"), F.count_if("is_error").alias("errors"))


#: What assembly should give, written from the parameters of the events and not from the operator:
#: one row per request side and, for closed sides without waiting requests, one per TCP span.
#: Times are in microseconds after the first event; own and up name the causes of a span and of its parent.
EXPECTED = """
WITH b AS (
    SELECT event_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS t0, 5000 + CAST(floor(value * 100) AS BIGINT) AS latency, CAST(40000 + event_id % 20001 AS INTEGER) AS src_port, event_id // 20001 AS closes,
        CASE event_id % 3 WHEN 0 THEN 1001 WHEN 1 THEN 1001 ELSE 1002 END AS client, CASE event_id % 3 WHEN 0 THEN 1002 WHEN 1 THEN 1003 ELSE 1004 END AS server,
        CASE event_id % 3 WHEN 2 THEN '172.17.0.3' ELSE '172.17.0.2' END AS src_ip, CASE event_id % 3 WHEN 0 THEN '172.17.0.3' WHEN 1 THEN '172.17.0.4' ELSE '172.17.0.5' END AS dst_ip,
        CASE event_id % 3 WHEN 0 THEN 8001 WHEN 1 THEN 8002 ELSE 8004 END AS dst_port, event_id % 11 <> 0 AS answered, event_id % 13 = 0 AS twice FROM events
), sides AS (
    SELECT *, client AS netns, n, 200 * n AS begin_us, CASE WHEN answered THEN latency - 500 + 200 * n ELSE latency END AS end_us FROM b, (VALUES (1), (2)) t(n) WHERE n = 1 OR twice
    UNION ALL
    SELECT *, server, n, 100 + 200 * n, CASE WHEN answered THEN latency - 600 + 200 * n ELSE latency END FROM b, (VALUES (1), (2)) t(n) WHERE n = 1 OR twice
), causes AS (
    SELECT *, src_ip || ':' || src_port || '>' || dst_ip || ':' || dst_port || '|' || netns || '|' || closes || '|1|' || n AS own,
        src_ip || ':' || src_port || '>' || dst_ip || ':' || dst_port || '|' || client || '|' || closes || '|1|' || n AS up FROM sides
), requests AS (
    SELECT md5('trace|' || up) AS trace_id, CAST('0x' || substr(md5('span|' || own), 1, 15) AS BIGINT) AS span_id, CASE WHEN netns = client THEN 0 ELSE CAST('0x' || substr(md5('span|' || up), 1, 15) AS BIGINT) END AS parent_span_id,
        CAST(netns AS BIGINT) AS netns, CASE n WHEN 1 THEN 'GET' ELSE 'POST' END AS http_method, CASE n WHEN 1 THEN '/' || event_type || '/' || event_id ELSE '/again/' || event_id END AS http_path, 'demo' AS http_host,
        CASE WHEN NOT answered THEN 0 WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, (t0 + begin_us) * 1000 AS start_time_ns, end_us - begin_us AS duration_us, src_ip, src_port, dst_ip, dst_port FROM causes
), bare AS (
    SELECT src_ip || ':' || src_port || '>' || dst_ip || ':' || dst_port || '|' || netns || '|' || closes || '|1|tcp' AS own, *
    FROM (SELECT *, client AS netns, 0 AS begin_us FROM b UNION ALL SELECT *, server, 100 FROM b) WHERE answered
), tcp AS (
    SELECT md5('trace|' || own), CAST('0x' || substr(md5('span|' || own), 1, 15) AS BIGINT), CAST(0 AS BIGINT), CAST(netns AS BIGINT), 'TCP', dst_ip || ':' || dst_port, dst_ip || ':' || dst_port, 0, (t0 + begin_us) * 1000, latency - begin_us, src_ip, src_port, dst_ip, dst_port FROM bare
)
"""
SHOWN = "SELECT *, http_status >= 400 AS is_error, parent_span_id = 0 AS is_root FROM"
STRICT = f"{EXPECTED} {SHOWN} requests"
WHOLE = f"{EXPECTED} {SHOWN} (SELECT * FROM requests UNION ALL SELECT * FROM tcp)"

#: In a burst of 70 the first 6 requests are forgotten, so that request n gets answer n - 6.
UNUSUAL = f"""
WITH b AS (
    SELECT event_id // 40 AS k, (event_id // 40) % 3 AS shape, CAST(epoch_us(ts) AS BIGINT) AS t0, CAST(1024 + event_id // 40 AS INTEGER) AS src_port FROM events WHERE event_id % 40 = 0
), expected(shape, netns, n, up_ns, up_n, root_ns, path, status, begin_at, end_at) AS (
    SELECT 0, 1001, n, NULL, NULL, 1001, '/' || n, 200, n, n - 6 + {adapters.BURST} FROM range(7, {adapters.BURST + 1}) t(n)
    UNION ALL VALUES (1, 1001, 1, NULL, NULL, 1001, '/a', 200, 1, 6), (1, 1002, 1, 1001, 1, 1001, '/a', 200, 2, 5), (1, 1003, 1, 1001, 1, 1001, '/a', 200, 3, 4)
    UNION ALL VALUES (2, 1001, 1, NULL, NULL, 1001, '/a', 0, 1, 5), (2, 1002, 1, 1001, 1, 1001, '/a', 0, 2, 5), (2, 1002, 2, 1002, 1, 1001, '/b', 0, 3, 5), (2, 1001, 2, 1002, 2, 1001, '/b', 0, 4, 5)
), c AS (
    SELECT *, '10.9.0.1:' || src_port || '>10.9.0.2:80|' AS conn FROM b JOIN expected USING (shape)
)
SELECT md5('trace|' || conn || root_ns || '|0|0|' || CASE shape WHEN 0 THEN n ELSE 1 END) AS trace_id, CAST('0x' || substr(md5('span|' || conn || netns || '|0|0|' || n), 1, 15) AS BIGINT) AS span_id,
    coalesce(CAST('0x' || substr(md5('span|' || conn || up_ns || '|0|0|' || up_n), 1, 15) AS BIGINT), 0) AS parent_span_id, CAST(netns AS BIGINT) AS netns, 'GET' AS http_method, path AS http_path, 'demo' AS http_host, CAST(status AS INTEGER) AS http_status,
    (t0 + 10 * begin_at) * 1000 AS start_time_ns, CAST(10 * (end_at - begin_at) AS BIGINT) AS duration_us, '10.9.0.1' AS src_ip, src_port, '10.9.0.2' AS dst_ip, CAST(80 AS INTEGER) AS dst_port, false AS is_error, up_ns IS NULL AS is_root FROM c
"""
SQL = {
    "span_assembly": WHOLE,
    "span_assembly_strict": STRICT,
    "span_assembly_stateful": WHOLE,
    "span_assembly_unusual": UNUSUAL,
    "span_assembly_incomplete": f"SELECT * FROM ({STRICT}) WHERE http_status = 0",
    "same_host_correlation": f"WITH all_spans AS ({STRICT}) SELECT a.trace_id, a.span_id, a.netns, b.netns AS parent_netns, a.http_path FROM all_spans a JOIN all_spans b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id",
    "assembled_services": f"""SELECT CASE netns WHEN 1001 THEN 'svc_api_gateway' WHEN 1002 THEN 'svc_user_service' WHEN 1003 THEN 'svc_payment_service' ELSE 'unknown' END AS service_id,
        CASE netns WHEN 1001 THEN 'c-gateway' WHEN 1002 THEN 'c-user' WHEN 1003 THEN 'c-payment' ELSE 'netns-' || netns END AS container_id, http_method,
        count(*) AS spans, count(*) FILTER (WHERE is_error) AS errors FROM ({WHOLE}) GROUP BY ALL""",
    "assembly_counters": """
        WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1001 WHEN 1 THEN 1001 ELSE 1002 END AS client, CASE event_id % 3 WHEN 0 THEN 1002 WHEN 1 THEN 1003 ELSE 1004 END AS server,
            length('GET /' || event_type || '/' || event_id || ' HTTP/1.1') + 16 + CASE WHEN event_id % 13 = 0 THEN length('POST /again/' || event_id || ' HTTP/1.1') + 16 ELSE 0 END AS asked,
            CASE WHEN event_id % 11 = 0 THEN 0 ELSE (CASE WHEN event_type = 'error' THEN 22 ELSE 19 END) * CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END END AS answered,
            CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS asks, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS answers FROM events)
        SELECT CAST(netns AS BIGINT) AS netns, CAST(sum(events) AS BIGINT) AS events, CAST(sum(asks) AS BIGINT) AS requests, CAST(sum(answers) AS BIGINT) AS responses, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS empty, CAST(sum(sent) AS BIGINT) AS bytes_sent, CAST(sum(received) AS BIGINT) AS bytes_received
        FROM (SELECT client AS netns, asks, answers, asked AS sent, answered AS received, 2 + asks + answers AS events FROM b UNION ALL SELECT server, asks, answers, answered, asked, 1 + asks + answers FROM b) GROUP BY netns""",
}

QUERIES = {f.__name__: f for f in (span_assembly, span_assembly_strict, span_assembly_incomplete, span_assembly_stateful, span_assembly_unusual, same_host_correlation, assembled_services, assembly_counters)}
