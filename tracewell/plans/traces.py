"""Queries over spans: traces, roll-ups, topology and correlation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tracewell.operators import rollup, topology, traces
from tracewell.sources import adapters, rollups, scratch, versions

PROJECT, SERVICE = "proj_demo", "svc_api_gateway"
SINCE, UNTIL = datetime(1998, 1, 1), datetime(1998, 4, 1)
TRACE = "a1d0c6e83f027327d8461063f4ac58a6"  # md5 of order 42

#: spans as a DuckDB table expression.
SPANS = """
WITH lines AS (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem
), base AS (
    SELECT md5(CAST(o_orderkey AS VARCHAR)) AS trace_id, o_orderkey * 1000 + 1 AS span_id, CAST(0 AS BIGINT) AS parent_span_id,
        CASE WHEN o_custkey % 10 = 0 THEN 'proj_other' ELSE 'proj_demo' END AS project_id, 'svc_api_gateway' AS service_id,
        CASE o_orderstatus WHEN 'O' THEN 'GET' WHEN 'P' THEN 'POST' ELSE 'PUT' END AS http_method,
        '/api/orders/' || o_orderkey AS http_path, '/api/orders/:id' AS http_route,
        CASE WHEN o_orderkey % 20 = 0 THEN 500 ELSE 200 END AS http_status,
        o_orderdate + to_seconds(o_orderkey % 86400) AS start_time, CAST(floor(o_totalprice) AS BIGINT) AS duration_us,
        'svc_s' || (o_custkey % 8) AS dst_service_id
    FROM orders
    UNION ALL
    SELECT md5(CAST(l_orderkey AS VARCHAR)), l_orderkey * 1000 + 1 + rn, l_orderkey * 1000 + 1,
        CASE WHEN o_custkey % 10 = 0 THEN 'proj_other' ELSE 'proj_demo' END, 'svc_s' || (l_suppkey % 8), 'GET',
        '/internal/parts/' || l_partkey, '/internal/parts/:id', CASE WHEN l_returnflag = 'R' THEN 500 ELSE 200 END,
        o_orderdate + to_seconds(l_orderkey % 86400) + to_milliseconds(rn), CAST(floor(l_extendedprice) AS BIGINT),
        CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'svc_db' || (l_partkey % 3) END
    FROM lines JOIN orders ON l_orderkey = o_orderkey
), spans AS (
    SELECT *, 'production' AS environment_id, http_status >= 400 AS is_error, parent_span_id = 0 AS is_root, span_id AS arrival_seq,
        time_bucket(INTERVAL '5 minutes', start_time) AS window_start FROM base
)
"""
ROLLUP = """count(*) AS request_count, count(*) FILTER (WHERE is_error) AS error_count,
    CAST(sum(duration_us) AS BIGINT) AS total_duration_us, min(duration_us) AS min_us, max(duration_us) AS max_us,
    quantile_cont(duration_us, 0.5) AS p50_us, quantile_cont(duration_us, 0.95) AS p95_us, quantile_cont(duration_us, 0.99) AS p99_us"""
MINE = f"project_id = '{PROJECT}' AND service_id = '{SERVICE}' AND start_time >= TIMESTAMP '{SINCE}'"
SUMMARY_SQL = f"""{SPANS}, summed AS (
    SELECT trace_id, max(duration_us) AS total_duration_us, count(*) AS span_count, bool_or(is_error) AS has_error,
        list(service_id) AS services, list(http_route) AS routes,
        arg_min({{'s': service_id, 'p': http_path, 'm': http_method, 't': start_time}}, CASE WHEN parent_span_id <> 0 THEN 4000000000000000000 ELSE 0 END + arrival_seq) AS root
    FROM spans WHERE project_id = '{PROJECT}' GROUP BY trace_id
), listed AS (
    SELECT trace_id, root.s AS root_service, root.p AS root_path, root.m AS root_method, total_duration_us, span_count, has_error,
        root.t AS start_time, services, routes FROM summed
)
"""
SUMMARY = ", ".join(traces.SUMMARY)
RECENT_SQL = SUMMARY_SQL.replace(f"project_id = '{PROJECT}'", f"project_id = '{PROJECT}' AND start_time BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'")


def spans(spark, sf_dir):
    return adapters.spans(spark, sf_dir)


def q1_trace_waterfall(spark, sf_dir):
    return traces.waterfall(spans(spark, sf_dir), PROJECT, TRACE)


def q2_service_metrics(spark, sf_dir):
    return rollup.service_metrics(spans(spark, sf_dir), PROJECT, SERVICE, SINCE)


_STORES: dict[tuple[str, str], str] = {}


def stored_rollup(spark, sf_dir):
    """Path of the stored roll-up of a folder's spans, added by months as a stream would and compacted; made once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORES:
        path = scratch.path(spark, "rollup")
        batch = F.pmod(F.year("start_time") * 12 + F.month("start_time"), F.lit(5)).cast("int")
        whole = scratch.written(spans(spark, sf_dir).select(*rollup.READS, batch.alias("_batch")), "rollup-input")
        for k in range(5):
            rollups.append(whole.where(F.col("_batch") == k).drop("_batch"), path, "spans", k)
            if k == 3:
                rollups.compact(spark, path, fan_in=4)
        _STORES[at] = path
    return _STORES[at]


def q2_service_metrics_stored(spark, sf_dir):
    return rollup.service_metrics_stored(rollups.read(spark, stored_rollup(spark, sf_dir), SINCE), PROJECT, SERVICE, SINCE)


def q3_top_endpoints_stored(spark, sf_dir):
    return rollup.top_endpoints_stored(rollups.read(spark, stored_rollup(spark, sf_dir), SINCE), PROJECT, SERVICE, SINCE)


def q8_error_rate_stored(spark, sf_dir):
    return rollup.error_rate_by_service_stored(rollups.read(spark, stored_rollup(spark, sf_dir), SINCE), PROJECT, SINCE)


def q2_counters_stored(spark, sf_dir):
    return q2_service_metrics_stored(spark, sf_dir).drop(*rollup.QUANTILES)


def q3_counters_stored(spark, sf_dir):
    return q3_top_endpoints_stored(spark, sf_dir).drop("p99_us")


def q8_counters_stored(spark, sf_dir):
    return q8_error_rate_stored(spark, sf_dir).drop("p99_us")


def rollup_compaction(spark, sf_dir):
    """Counters by service from the version before a compaction, the one it made and the newest."""
    path = stored_rollup(spark, sf_dir)
    numbers = versions.numbers(spark, path)
    done = next(n for n in numbers if any(x["level"] for x in versions.version(spark, path, n).notes["folders"].values()))
    shown = {"before": done - 1, "after": done, "newest": numbers[-1]}
    merged = [rollup.recounted(rollups.read(spark, path, number=n), ["project_id", "service_id"]).withColumn("phase", F.lit(phase)) for phase, n in shown.items()]
    return merged[0].unionByName(merged[1]).unionByName(merged[2])


def rollup_stored_counters(spark, sf_dir):
    """Counters of stored partial rows, merged to services; the sketches of the same rows merge beside them."""
    return rollup.merged(rollups.read(spark, stored_rollup(spark, sf_dir)), ["project_id", "service_id"]).drop(*rollup.QUANTILES)


def span_details(spark, sf_dir):
    """Detail rows; blank routes are made from the path."""
    blank = F.when(F.col("span_id") % 2 == 0, F.lit("")).otherwise(F.lit("/given"))
    return traces.detail_rows(spans(spark, sf_dir).withColumn("http_route", blank))


def q3_top_endpoints(spark, sf_dir):
    return rollup.top_endpoints(spans(spark, sf_dir), PROJECT, SERVICE, SINCE)


def q4_dependency_graph(spark, sf_dir):
    return topology.graph(topology.edges(spans(spark, sf_dir)), PROJECT, SINCE)


def q5_slow_roots(spark, sf_dir):
    # Roots come from orders alone, so lines are neither read nor joined.
    return traces.slow_roots(adapters.root_spans(spark, sf_dir), PROJECT, SERVICE, SINCE, over_us=100_000)


def q6_spike_spans(spark, sf_dir):
    return traces.spike_spans(spans(spark, sf_dir), PROJECT, SERVICE, datetime(1996, 1, 1), datetime(1996, 3, 1), 100_000)


def q7_trace_logs(spark, sf_dir):
    return traces.trace_logs(adapters.trace_logs(spark, sf_dir), PROJECT, "c4ca4238a0b923820dcc509a6f75849b")


def q8_error_rate_by_service(spark, sf_dir):
    return rollup.error_rate_by_service(spans(spark, sf_dir), PROJECT, SINCE)


def r2_trace_list(spark, sf_dir):
    return traces.list_traces(spans(spark, sf_dir), PROJECT, service="svc_s3", min_duration_us=50_000)


def r2_trace_list_recent(spark, sf_dir):
    """Only spans of the time asked for are read and folded."""
    return traces.list_traces(spans(spark, sf_dir), PROJECT, service="svc_s3", since=SINCE, until=UNTIL)


def r11_metric_to_traces_recent(spark, sf_dir):
    return traces.metric_to_traces(spans(spark, sf_dir), PROJECT, "svc_s1", "p99_latency_us", min_duration_us=50_000, since=SINCE, until=UNTIL)


def r2_trace_list_errors(spark, sf_dir):
    return traces.list_traces(spans(spark, sf_dir), PROJECT, route="/internal/parts/:id", errors_only=True, limit=30)


def r3_trace_detail(spark, sf_dir):
    found = traces.trace_detail(spans(spark, sf_dir), PROJECT, TRACE)
    return found.withColumn("span_ids", F.array_join(F.transform("spans", lambda s: s["span_id"].cast("string")), ",")).drop("spans")


def r5_topology_nodes(spark, sf_dir):
    return topology.nodes(topology.live_edges(spans(spark, sf_dir)))


def r5_live_edges(spark, sf_dir):
    return topology.live_edges(spans(spark, sf_dir))


def r11_metric_to_traces_latency(spark, sf_dir):
    return traces.metric_to_traces(spans(spark, sf_dir), PROJECT, "svc_s1", "p99_latency_us", min_duration_us=100_000)


def r11_metric_to_traces_errors(spark, sf_dir):
    return traces.metric_to_traces(spans(spark, sf_dir), PROJECT, "svc_s1", "error_rate")


def r12_synth_logs(spark, sf_dir):
    return traces.synthesised_logs(spans(spark, sf_dir), PROJECT, TRACE)


def rollup_5min_exact(spark, sf_dir):
    return rollup.exact(spans(spark, sf_dir))


def rollup_remerge(spark, sf_dir):
    return rollup.recounted(rollup.exact(spans(spark, sf_dir)), ["project_id", "service_id"])


def rollup_kll(spark, sf_dir):
    return rollup.merged(rollup.partial(spans(spark, sf_dir)), ["project_id", "service_id"])


def dependency_5min(spark, sf_dir):
    return topology.edges(spans(spark, sf_dir))


def spike_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    return traces.spike_join(s, rollup.exact(s, ["project_id", "service_id", "window_start"]))


def parent_links(spark, sf_dir):
    return traces.parent_links(spans(spark, sf_dir))


def ttl_retention(spark, sf_dir):
    return rollup.retained(spans(spark, sf_dir), "start_time", datetime(2001, 8, 1), 7).select("trace_id", "span_id", "start_time")


SQL = {
    "q1_trace_waterfall": f"{SPANS} SELECT {', '.join(traces.WATERFALL)} FROM spans WHERE project_id = '{PROJECT}' AND trace_id = '{TRACE}' ORDER BY start_time, span_id",
    "q2_service_metrics": f"{SPANS} SELECT window_start, request_count, error_count, error_count / request_count AS error_rate, p50_us, p95_us, p99_us, min_us, max_us FROM (SELECT window_start, {ROLLUP} FROM spans WHERE {MINE} GROUP BY window_start)",
    "q3_top_endpoints": f"{SPANS} SELECT http_route, http_method, request_count, error_count, p99_us FROM (SELECT http_route, http_method, {ROLLUP} FROM spans WHERE {MINE} GROUP BY ALL) ORDER BY request_count DESC, http_route, http_method LIMIT 20",
    "q4_dependency_graph": f"""{SPANS} SELECT service_id AS caller_service_id, dst_service_id AS callee_service_id, count(*) AS total_calls,
        count(*) FILTER (WHERE is_error) AS total_errors, count(*) FILTER (WHERE is_error) / count(*) AS error_rate, CAST(sum(duration_us) AS BIGINT) / count(*) AS avg_duration_us
        FROM spans WHERE dst_service_id <> '' AND project_id = '{PROJECT}' AND window_start >= TIMESTAMP '{SINCE}' GROUP BY ALL""",
    "q5_slow_roots": f"{SPANS} SELECT trace_id, service_id, http_method, http_path, http_status, duration_us, start_time, is_error FROM spans WHERE {MINE} AND duration_us > 100000 AND is_root ORDER BY duration_us DESC, trace_id LIMIT 50",
    "q6_spike_spans": f"""{SPANS} SELECT trace_id, span_id, service_id, http_method, http_path, http_status, duration_us, start_time FROM spans
        WHERE project_id = '{PROJECT}' AND service_id = '{SERVICE}' AND start_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-01' AND duration_us > 100000
        ORDER BY duration_us DESC, trace_id, span_id LIMIT 20""",
    "q7_trace_logs": """SELECT 'svc_' || role AS service_id, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(conv_id * 3600 + turn) AS timestamp,
        CASE WHEN role = 'user' THEN 'INFO' ELSE 'DEBUG' END AS log_level, md5(text) AS message, conv_id * 1000 + turn AS span_id FROM conversations WHERE conv_id = 1""",
    "q8_error_rate_by_service": f"{SPANS} SELECT service_id, request_count AS requests, error_count AS errors, error_count / request_count AS error_rate, p99_us FROM (SELECT service_id, {ROLLUP} FROM spans WHERE project_id = '{PROJECT}' AND start_time >= TIMESTAMP '{SINCE}' GROUP BY service_id)",
    "r2_trace_list": f"{SUMMARY_SQL} SELECT {SUMMARY} FROM listed WHERE list_contains(services, 'svc_s3') AND total_duration_us >= 50000 ORDER BY start_time DESC, trace_id LIMIT 50",
    "r2_trace_list_recent": f"{RECENT_SQL} SELECT {SUMMARY} FROM listed WHERE list_contains(services, 'svc_s3') ORDER BY start_time DESC, trace_id LIMIT 50",
    "r11_metric_to_traces_recent": f"{RECENT_SQL} SELECT {SUMMARY} FROM listed WHERE list_contains(services, 'svc_s1') AND total_duration_us >= 50000 ORDER BY total_duration_us DESC, trace_id LIMIT 50",
    "r2_trace_list_errors": f"{SUMMARY_SQL} SELECT {SUMMARY} FROM listed WHERE list_contains(routes, '/internal/parts/:id') AND has_error ORDER BY start_time DESC, trace_id LIMIT 30",
    "r3_trace_detail": f"{SPANS} SELECT trace_id, max(duration_us) AS total_duration_us, count(*) AS span_count, bool_or(is_error) AS has_error, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY arrival_seq) AS span_ids FROM spans WHERE project_id = '{PROJECT}' AND trace_id = '{TRACE}' GROUP BY trace_id",
    "r5_live_edges": f"{SPANS} SELECT service_id AS caller, dst_service_id AS callee, count(*) AS call_count, count(*) FILTER (WHERE is_error) AS error_count, CAST(sum(duration_us) AS BIGINT) / count(*) AS avg_duration_us FROM spans WHERE dst_service_id <> '' AND service_id <> dst_service_id GROUP BY ALL",
    "r5_topology_nodes": f"""{SPANS}, e AS (SELECT service_id AS caller, dst_service_id AS callee, count(*) AS n FROM spans WHERE dst_service_id <> '' AND service_id <> dst_service_id GROUP BY ALL)
        SELECT service_id, CAST(sum(n) AS BIGINT) AS request_count, CAST(0 AS DOUBLE) AS error_rate, CAST(0 AS DOUBLE) AS p99_latency_us
        FROM (SELECT caller AS service_id, n FROM e UNION ALL SELECT callee, 0 FROM e) GROUP BY service_id""",
    "r11_metric_to_traces_latency": f"{SUMMARY_SQL} SELECT {SUMMARY} FROM listed WHERE list_contains(services, 'svc_s1') AND total_duration_us >= 100000 ORDER BY total_duration_us DESC, trace_id LIMIT 50",
    "r11_metric_to_traces_errors": f"{SUMMARY_SQL} SELECT {SUMMARY} FROM listed WHERE list_contains(services, 'svc_s1') AND has_error ORDER BY total_duration_us DESC, trace_id LIMIT 50",
    "r12_synth_logs": f"{SPANS} SELECT service_id, span_id, start_time AS timestamp, CASE WHEN is_error THEN 'ERROR' ELSE 'INFO' END AS log_level, http_method || ' ' || http_path || ' → ' || http_status || ' (' || duration_us || 'µs)' AS message FROM spans WHERE project_id = '{PROJECT}' AND trace_id = '{TRACE}'",
    "rollup_5min_exact": f"{SPANS} SELECT project_id, service_id, environment_id, http_route, http_method, window_start, {ROLLUP} FROM spans GROUP BY ALL",
    "rollup_remerge": f"{SPANS} SELECT project_id, service_id, count(*) AS request_count, count(*) FILTER (WHERE is_error) AS error_count, CAST(sum(duration_us) AS BIGINT) AS total_duration_us, min(duration_us) AS min_us, max(duration_us) AS max_us FROM spans GROUP BY ALL",
    "dependency_5min": f"""{SPANS} SELECT project_id, environment_id, service_id AS caller_service_id, dst_service_id AS callee_service_id, window_start, count(*) AS call_count,
        count(*) FILTER (WHERE is_error) AS error_count, CAST(sum(duration_us) AS BIGINT) AS total_duration_us, count(*) AS duration_count FROM spans WHERE dst_service_id <> '' GROUP BY ALL""",
    "spike_join": f"""{SPANS}, r AS (SELECT project_id, service_id, window_start, quantile_cont(duration_us, 0.99) AS p99_us FROM spans GROUP BY ALL)
        SELECT project_id, service_id, window_start, trace_id, span_id, duration_us FROM spans JOIN r USING (project_id, service_id, window_start) WHERE duration_us > p99_us""",
    # A line's parent is its order's span, which begins rn milliseconds before it.
    "parent_links": """SELECT md5(CAST(l_orderkey AS VARCHAR)) AS trace_id, l_orderkey * 1000 + 1 + rn AS span_id, 'svc_api_gateway' AS parent_service, 'svc_s' || (l_suppkey % 8) AS service_id, rn * 1000 AS offset_us
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "span_details": f"""{SPANS} SELECT trace_id, span_id, parent_span_id, service_id, http_method, http_path, CASE WHEN span_id % 2 = 1 THEN '/given' ELSE http_route END AS http_route, http_status, start_time, duration_us, is_error FROM spans""",
    "rollup_stored_counters": f"{SPANS} SELECT project_id, service_id, count(*) AS request_count, count(*) FILTER (WHERE is_error) AS error_count, CAST(sum(duration_us) AS BIGINT) AS total_duration_us, min(duration_us) AS min_us, max(duration_us) AS max_us FROM spans GROUP BY ALL",
    "q2_counters_stored": f"{SPANS} SELECT window_start, request_count, error_count, error_count / request_count AS error_rate, min_us, max_us FROM (SELECT window_start, {ROLLUP} FROM spans WHERE {MINE} GROUP BY window_start)",
    "q3_counters_stored": f"{SPANS} SELECT http_route, http_method, request_count, error_count FROM (SELECT http_route, http_method, {ROLLUP} FROM spans WHERE {MINE} GROUP BY ALL) ORDER BY request_count DESC, http_route, http_method LIMIT 20",
    "q8_counters_stored": f"{SPANS} SELECT service_id, request_count AS requests, error_count AS errors, error_count / request_count AS error_rate FROM (SELECT service_id, {ROLLUP} FROM spans WHERE project_id = '{PROJECT}' AND start_time >= TIMESTAMP '{SINCE}' GROUP BY service_id)",
    # The versions before and after the compaction hold batches 0 to 3, the newest all.
    "rollup_compaction": f"""{SPANS} SELECT phase, project_id, service_id, count(*) AS request_count, count(*) FILTER (WHERE is_error) AS error_count, CAST(sum(duration_us) AS BIGINT) AS total_duration_us, min(duration_us) AS min_us, max(duration_us) AS max_us
        FROM spans, (VALUES ('before', 3), ('after', 3), ('newest', 4)) t(phase, last) WHERE (year(start_time) * 12 + month(start_time)) % 5 <= last GROUP BY ALL""",
    "ttl_retention": f"{SPANS} SELECT trace_id, span_id, start_time FROM spans WHERE start_time >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY",
}

QUERIES = {f.__name__: f for f in (
    q1_trace_waterfall, q2_service_metrics, q3_top_endpoints, q4_dependency_graph, q5_slow_roots, q6_spike_spans, q7_trace_logs, q8_error_rate_by_service,
    r2_trace_list, r2_trace_list_recent, r11_metric_to_traces_recent, r2_trace_list_errors, r3_trace_detail, r5_topology_nodes, r5_live_edges, r11_metric_to_traces_latency, r11_metric_to_traces_errors,
    r12_synth_logs, rollup_5min_exact, rollup_remerge, rollup_kll, dependency_5min, spike_join, parent_links, ttl_retention,
    q2_service_metrics_stored, q3_top_endpoints_stored, q8_error_rate_stored, q2_counters_stored, q3_counters_stored, q8_counters_stored, rollup_compaction, rollup_stored_counters, span_details,
)}
