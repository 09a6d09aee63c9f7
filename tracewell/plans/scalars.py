"""Queries over the scalar functions, decoders and the service mapping; inputs are made from pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import http, spans as fn
from tracewell.operators import rules
from tracewell.sources import adapters, discovery

CR = "\r\n"
Q = "chr(13) || chr(10)"


def _pages(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "pages").select("page_id", "url")
    return p.withColumn("path", F.regexp_extract("url", "^https?://[^/]+(.*)$", 1))


PAGES = "WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path FROM pages)"


def route_normalize(spark, sf_dir):
    longer = F.concat(F.col("path"), F.lit("/u/"), F.md5("url"), F.lit("/"), F.substring(F.md5("path"), 1, 15), F.lit("/7f"))
    rows = _pages(spark, sf_dir).select("page_id", F.explode(F.array("path", F.split("path", "[?#]")[0], F.concat(F.split("path", "[?#]")[0], F.lit("/u/"), F.md5("url"), F.lit("/7f")), longer, F.lit("/"), F.lit("?x=1"))).alias("path"))
    return rows.select("page_id", "path", http.normalize_route(F.col("path")).alias("route"))


def traceparent_parse(spark, sf_dir):
    k = F.col("page_id") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("00-"), F.md5("url"), F.lit("-0000000000000000-01")))
        .when(k == 1, F.concat(F.lit("00-"), F.lit("0" * 32), F.lit("-"), F.substring(F.md5("path"), 1, 16), F.lit("-01")))
        .when(k == 2, F.concat(F.lit("00-"), F.md5("url"), F.lit("-01")))
        .when(k == 3, F.concat(F.lit("00-"), F.upper(F.md5("url")), F.lit("-"), F.substring(F.md5("path"), 1, 16), F.lit("-00")))
        .when(k == 4, F.concat(F.lit("0g-"), F.md5("url"), F.lit("-"), F.substring(F.md5("path"), 1, 16), F.lit("-01")))
        .otherwise(F.concat(F.lit(" 000ff-"), F.md5("url"), F.lit("-"), F.substring(F.md5("path"), 1, 16), F.lit("-03 ")))
    )
    x = http.parse_traceparent(text)
    return _pages(spark, sf_dir).select("page_id", text.alias("header"), F.coalesce(x["version"], F.lit(-1)).alias("version"), x["trace_id"].alias("trace_id"), F.coalesce(http.hex_to_long(x["parent_hex"]), F.lit(0)).alias("parent_span_id"), http.unsigned_text(http.hex_to_long(x["parent_hex"])).alias("parent_shown"), F.coalesce(http.sampled(x["flags"]), F.lit(False)).alias("sampled"))


def _request():
    k = F.col("page_id") % 6
    return F.encode(
        F.when(k == 0, F.concat(F.lit("GET "), F.col("path"), F.lit(f" HTTP/1.1{CR}Host: a{CR}{CR}")))
        .when(k == 1, F.concat(F.lit("POST "), F.col("path"), F.lit(" HTTP/1.1")))
        .when(k == 2, F.concat(F.lit("get "), F.col("path"), F.lit(f" HTTP/1.1{CR}")))
        .when(k == 3, F.concat(F.lit("DELETE "), F.col("path"), F.lit(CR)))
        .when(k == 4, F.concat(F.lit("OPTIONS "), F.col("path"), F.lit(f" any thing{CR}")))
        .otherwise(F.concat(F.lit("PATCH é"), F.col("path"), F.lit(f" HTTP/2{CR}{CR}"))),
        "UTF-8",
    )


def http_request_parse(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("payload", _request())
    x = http.parse_request(F.col("payload"))
    return rows.select("page_id", http.is_request(F.col("payload")).alias("is_request"), http.passes_prefilter(F.col("payload")).alias("passes"), x["method"].alias("method"), x["path"].alias("path"), x["version"].alias("version"))


def _response():
    k = F.col("page_id") % 6
    return F.encode(
        F.when(k == 0, F.lit(f"HTTP/1.1 200 OK{CR}{CR}"))
        .when(k == 1, F.lit(f"HTTP/1.1 404{CR}"))
        .when(k == 2, F.lit(f"HTTP/1.1 99 Low{CR}"))
        .when(k == 3, F.lit(f"HTTP/1.1 abc{CR}"))
        .when(k == 4, F.concat(F.lit("HTTP/2 50"), (F.col("page_id") % 10).cast("string"), F.lit(f" Server is down{CR}")))
        .otherwise(F.lit("HTTP/1.1 200 OK")),
        "UTF-8",
    )


def http_response_parse(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("payload", _response())
    x = http.parse_response(F.col("payload"))
    return rows.select("page_id", http.is_response(F.col("payload")).alias("is_response"), x["version"].alias("version"), F.coalesce(x["status"], F.lit(-1)).alias("status"), x["reason"].alias("reason"), F.coalesce(http.is_error_status(x["status"]), F.lit(False)).alias("is_error"), F.coalesce(http.is_server_error(x["status"]), F.lit(False)).alias("is_server_error"))


def header_parse(spark, sf_dir):
    text = F.concat(F.lit(f"GET / HTTP/1.1{CR}HOST:  first{CR}no colon{CR}: empty{CR}Host: "), F.col("page_id").cast("string"), F.lit(f" {CR}Content-Length: "), F.when(F.col("page_id") % 3 == 0, "x1").otherwise(F.length("url").cast("string")), F.lit(f"{CR}X-Url: "), F.col("url"), F.when(F.col("page_id") % 2 == 0, f"{CR}{CR}Late: body{CR}").otherwise(f"{CR}cut: off"))
    rows = _pages(spark, sf_dir).withColumn("headers", http.parse_headers(F.encode(text, "UTF-8")))
    h = F.col("headers")
    return rows.select("page_id", http.header(h, "Host").alias("host"), F.coalesce(http.content_length(h), F.lit(-1)).alias("content_length"), http.header(h, "x-url").alias("x_url"), F.array_join(F.array_sort(F.map_keys(h)), ",").alias("names"))


def netns_parse(spark, sf_dir):
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.concat(F.lit("net:["), (F.col("page_id") + 4026531840).cast("string"), F.lit("]"))).when(k == 1, F.concat(F.lit("net:["), (F.col("page_id") * 10 + 4294967295).cast("string"), F.lit("]"))).when(k == 2, F.lit("mnt:[12]")).otherwise(F.lit("net:[]"))
    return _pages(spark, sf_dir).select("page_id", link.alias("link"), F.coalesce(fn.netns_of(link), F.lit(-1)).alias("netns"))


def docker_event_parse(spark, sf_dir):
    k = F.col("page_id") % 4
    line = F.when(k == 0, F.concat(F.lit("  start "), F.md5("url"), F.lit(" "))).when(k == 1, F.concat(F.lit("die "), F.md5("url"))).when(k == 2, F.concat(F.lit("pause "), F.md5("url"))).otherwise(F.lit("start"))
    x = fn.docker_event(line)
    return _pages(spark, sf_dir).select("page_id", x["action"].alias("action"), x["id"].alias("container"))


def docker_inspect(spark, sf_dir):
    k = F.col("page_id") % 5
    labels = (
        F.when(k == 0, F.concat(F.lit('{"observe.service":"api-'), F.col("page_id").cast("string"), F.lit('","observe.project":"proj","observe.environment":"prod"}')))
        .when(k == 1, F.lit('{"observe.service":""}')).when(k == 2, F.lit("null")).otherwise(F.concat(F.lit('{"observe.service":"web-'), F.col("page_id").cast("string"), F.lit('"}')))
    )
    text = F.concat(F.lit('[{"Id":"'), F.md5("url"), F.lit('","Name":"/c-'), F.col("page_id").cast("string"), F.lit('","State":{"Pid":'), F.col("page_id").cast("string"), F.lit(',"Running":'), F.when(k == 4, "false").otherwise("true"), F.lit('},"Config":{"Labels":'), labels, F.lit("}}]"))
    return discovery.inspected(_pages(spark, sf_dir).select("page_id", text.alias("inspect"))).drop("inspect")


def service_enrich_left(spark, sf_dir):
    events = adapters.tcp_events(spark, sf_dir).select("seq", "netns", "kind")
    return discovery.enriched(events, adapters.mapping(spark))


def dst_service_resolve(spark, sf_dir):
    from tracewell.operators import topology

    addresses = spark.createDataFrame([("172.17.0.3", "svc_user_service"), ("172.17.0.5", "svc_db_service")], "ip string, service_id string")
    return topology.resolve_callee(adapters.tcp_events(spark, sf_dir).where("kind = 'connect'").select("seq", "dst_ip"), addresses)


def _changes(spark, sf_dir):
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") + 1000).alias("netns"), F.col("event_type").alias("service_id"), F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("container_id"))


def mapping_upsert(spark, sf_dir):
    return discovery.upsert(_changes(spark, sf_dir))


def mapping_delete_anti(spark, sf_dir):
    gone = adapters.table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 100").select((F.col("user_id") + 1000).alias("netns"))
    return discovery.remove(discovery.upsert(_changes(spark, sf_dir)), gone, "netns")


def event_decode(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    return e.select("event_id", fn.event_kind(F.col("event_id") % 6).alias("kind"), fn.shown_tuple(F.lit("10.0.0.1"), (F.col("event_id") % 65536).cast("int"), F.lit("10.0.0.2"), F.lit(80)).alias("shown"), fn.stored_ip(F.when(F.col("event_id") % 2 == 0, "10.1.2.3").otherwise("fe80::1")).alias("ip"), fn.duration_us(F.col("event_id") * 1000, F.lit(5_000_999)).alias("duration_us"))


def config_decode(spark, sf_dir):
    """Rule configs as JSON, of each type and broken."""
    k = F.col("event_id") % 4
    number = F.get_json_object("props", "$.k")
    text = (
        F.when(k == 0, F.concat(F.lit('{"type":"threshold","metric":"error_rate","operator":">=","value":0.5,"min_requests":10,"window_secs":'), number, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"type":"anomaly","metric":"p95_latency_us","baseline_window_secs":3600,"z_score_threshold":3.5,"evaluation_window_secs":'), number, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"type":"rate_of_change","metric":"request_count","change_threshold_pct":-50,"window_secs":'), number, F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    raw = adapters.table(spark, sf_dir, "events").select("event_id", text.alias("config"))
    return rules.decode_config(raw)


def id_functions(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.upper(F.md5("event_type"))).when(k % 3 == 1, F.md5("event_type")).otherwise(F.concat(F.lit("g"), F.substring(F.md5("event_type"), 2, 31)))
    raw = fn.trace_from_hex(text)
    swapped = fn.reversed_tuple("src_ip", "src_port", "dst_ip", "dst_port")
    rows = adapters.table(spark, sf_dir, "events").withColumns({"src_ip": F.lit("10.0.0.1"), "src_port": (k % 65536).cast("int"), "dst_ip": F.lit("10.0.0.2"), "dst_port": F.lit(80)})
    return rows.select("event_id", F.coalesce(fn.trace_hex(raw), F.lit("none")).alias("trace_id"), fn.ns_to_timestamp(F.lit(1_700_000_000_000_000_000) + k * 1_234_567).alias("begun"), fn.shown_tuple(swapped["src_ip"], swapped["src_port"], swapped["dst_ip"], swapped["dst_port"]).alias("reversed"))


def date_keys(spark, sf_dir):
    found = adapters.table(spark, sf_dir, "events").select("event_id", *fn.date_keys(F.col("ts").cast("timestamp")))
    return found.withColumn("day", F.col("day").cast("string"))


def payload_tests(spark, sf_dir):
    """Whether a payload is HTTP, and how much of it a capture keeps."""
    body = F.concat(F.when(F.col("page_id") % 3 == 0, "GET / HTTP/1.1\r\n").when(F.col("page_id") % 3 == 1, "HTTP/1.1 200 OK\r\n").otherwise("gopher "), F.repeat(F.lit("x"), (F.col("page_id") % 50 * 100).cast("int")))
    payload = F.encode(body, "UTF-8")
    return _pages(spark, sf_dir).select("page_id", http.is_http(payload).alias("is_http"), F.octet_length(http.clipped(payload)).alias("kept"))


STEPS = """WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1001 WHEN 1 THEN 1001 ELSE 1002 END AS client, CASE event_id % 3 WHEN 0 THEN 1002 WHEN 1 THEN 1003 ELSE 1004 END AS server FROM events),
    steps(k, kind, side, what) AS (VALUES (0, 'connect', 'c', ''), (1, 'accept', 's', ''), (2, 'send', 'c', ''), (3, 'recv', 's', ''), (4, 'send', 'c', 'twice'), (5, 'recv', 's', 'twice'),
        (6, 'send', 's', 'answer'), (7, 'recv', 'c', 'answer'), (8, 'send', 's', 'both'), (9, 'recv', 'c', 'both'), (10, 'close', 'c', '')),
    e AS (SELECT event_id * 16 + k AS seq, event_id, kind, CAST(CASE side WHEN 'c' THEN client ELSE server END AS BIGINT) AS netns FROM b, steps
        WHERE (what NOT IN ('twice', 'both') OR event_id % 13 = 0) AND (what NOT IN ('answer', 'both') OR event_id % 11 <> 0))"""
EVENT = """CASE event_id % 6 WHEN 0 THEN 'connect' WHEN 1 THEN 'accept' WHEN 2 THEN 'send' WHEN 3 THEN 'recv' ELSE 'close' END"""
SQL = {
    "route_normalize": PAGES + r""", v AS (SELECT page_id, unnest([path, regexp_split_to_array(path, '[?#]')[1], regexp_split_to_array(path, '[?#]')[1] || '/u/' || md5(url) || '/7f',
            path || '/u/' || md5(url) || '/' || substr(md5(path), 1, 15) || '/7f', '/', '?x=1']) AS path FROM p),
        b AS (SELECT *, split_part(split_part(path, '?', 1), '#', 1) AS bare FROM v)
        SELECT page_id, path, CASE WHEN bare IN ('', '/') THEN '/' ELSE array_to_string(list_transform(string_split(bare, '/'),
            lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9A-Fa-f]{16,}|[A-Za-z0-9_-]{32,}') THEN ':id' ELSE s END), '/') END AS route FROM b""",
    "traceparent_parse": PAGES + r""", h AS (SELECT page_id, CASE page_id % 7
            WHEN 0 THEN '00-' || md5(url) || '-0000000000000000-01' WHEN 1 THEN '00-' || repeat('0', 32) || '-' || substr(md5(path), 1, 16) || '-01'
            WHEN 2 THEN '00-' || md5(url) || '-01' WHEN 3 THEN '00-' || upper(md5(url)) || '-' || substr(md5(path), 1, 16) || '-00'
            WHEN 4 THEN '0g-' || md5(url) || '-' || substr(md5(path), 1, 16) || '-01' ELSE ' 000ff-' || md5(url) || '-' || substr(md5(path), 1, 16) || '-03 ' END AS header FROM p),
        x AS (SELECT *, string_split(trim(header), '-') AS f FROM h),
        y AS (SELECT *, len(f) = 4 AND regexp_full_match(f[1], '0*[0-9a-fA-F]{1,2}') AND regexp_full_match(f[2], '[0-9a-fA-F]{32}') AND regexp_full_match(f[3], '[0-9a-fA-F]{16}')
            AND regexp_full_match(f[4], '[0-9a-fA-F]{2}') AND f[2] <> repeat('0', 32) AND f[3] <> repeat('0', 16) AS good FROM x),
        z AS (SELECT *, CASE WHEN good THEN CAST('0x' || f[3] AS UBIGINT) END AS u FROM y)
        SELECT page_id, header, CASE WHEN good THEN CAST(CAST('0x' || f[1] AS BIGINT) AS INTEGER) ELSE -1 END AS version, CASE WHEN good THEN lower(f[2]) END AS trace_id,
            CAST(coalesce(CASE WHEN CAST(u AS HUGEINT) >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE CAST(u AS HUGEINT) END, 0) AS BIGINT) AS parent_span_id,
            CAST(u AS VARCHAR) AS parent_shown, CASE WHEN good THEN CAST('0x' || f[4] AS INTEGER) % 2 = 1 ELSE false END AS sampled FROM z""",
    "http_request_parse": PAGES + f""", r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'GET ' || path || ' HTTP/1.1' || {Q} || 'Host: a' || {Q} || {Q}
            WHEN 1 THEN 'POST ' || path || ' HTTP/1.1' WHEN 2 THEN 'get ' || path || ' HTTP/1.1' || {Q} WHEN 3 THEN 'DELETE ' || path || {Q}
            WHEN 4 THEN 'OPTIONS ' || path || ' any thing' || {Q} ELSE 'PATCH é' || path || ' HTTP/2' || {Q} || {Q} END AS t FROM p),
        l AS (SELECT *, CASE WHEN contains(t, {Q}) THEN split_part(t, {Q}, 1) END AS line FROM r),
        f AS (SELECT *, regexp_extract(line, '^([^ ]*) ([^ ]*) (.*)$', ['m', 'p', 'v']) AS g, regexp_full_match(line, '[^ ]* [^ ]* .*') AS good FROM l)
        SELECT page_id, regexp_matches(t, '^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE) ') AS is_request,
            substr(t, 1, 2) IN ('GE', 'PO', 'PU', 'DE', 'PA', 'HE', 'OP', 'CO', 'TR', 'HT') AS passes,
            CASE WHEN good THEN g.m END AS method, CASE WHEN good THEN g.p END AS path, CASE WHEN good THEN g.v END AS version FROM f""",
    "http_response_parse": PAGES + f""", r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'HTTP/1.1 200 OK' || {Q} || {Q} WHEN 1 THEN 'HTTP/1.1 404' || {Q}
            WHEN 2 THEN 'HTTP/1.1 99 Low' || {Q} WHEN 3 THEN 'HTTP/1.1 abc' || {Q} WHEN 4 THEN 'HTTP/2 50' || (page_id % 10) || ' Server is down' || {Q} ELSE 'HTTP/1.1 200 OK' END AS t FROM p),
        l AS (SELECT *, CASE WHEN contains(t, {Q}) THEN split_part(t, {Q}, 1) END AS line FROM r),
        s AS (SELECT *, try_cast(split_part(line, ' ', 2) AS INTEGER) AS code FROM l),
        g AS (SELECT *, line IS NOT NULL AND coalesce(code BETWEEN 100 AND 599, false) AS good FROM s)
        SELECT page_id, starts_with(t, 'HTTP/') AS is_response, CASE WHEN good THEN split_part(line, ' ', 1) END AS version, CASE WHEN good THEN code ELSE -1 END AS status,
            CASE WHEN good THEN regexp_replace(line, '^[^ ]* [^ ]* ?', '') END AS reason, good AND code >= 400 AS is_error, good AND code >= 500 AS is_server_error FROM g""",
    "header_parse": PAGES + """ SELECT page_id, CAST(page_id AS VARCHAR) AS host, CASE WHEN page_id % 3 <> 0 THEN CAST(length(url) AS BIGINT) ELSE -1 END AS content_length, url AS x_url,
            'content-length,host,x-url' AS names FROM p""",
    "netns_parse": PAGES + """, l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'net:[' || (page_id + 4026531840) || ']' WHEN 1 THEN 'net:[' || (page_id * 10 + 4294967295) || ']' WHEN 2 THEN 'mnt:[12]' ELSE 'net:[]' END AS link FROM p),
        n AS (SELECT *, try_cast(regexp_extract(link, '^net:\\[([0-9]+)\\]$', 1) AS BIGINT) AS v FROM l) SELECT page_id, link, CASE WHEN v <= 4294967295 THEN v ELSE -1 END AS netns FROM n""",
    "docker_event_parse": PAGES + " SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'die' END AS action, CASE WHEN page_id % 4 < 2 THEN md5(url) END AS container FROM p",
    "docker_inspect": PAGES + """ SELECT page_id, substr(md5(url), 1, 12) AS container_id, 'c-' || page_id AS container_name, page_id AS pid, CASE WHEN page_id % 5 = 0 THEN 'proj' ELSE 'default' END AS project_id,
            CASE WHEN page_id % 5 = 0 THEN 'svc_api_' ELSE 'svc_web_' END || page_id AS service_id, CASE WHEN page_id % 5 = 0 THEN 'api-' ELSE 'web-' END || page_id AS service_name,
            CASE WHEN page_id % 5 = 0 THEN 'prod' ELSE 'development' END AS environment_id FROM p WHERE page_id % 5 IN (0, 3) AND page_id > 0""",
    "mapping_upsert": "SELECT user_id + 1000 AS netns, arg_max(event_type, event_id) AS service_id, 'c-' || max(event_id) AS container_id FROM events GROUP BY user_id",
    "mapping_delete_anti": "SELECT user_id + 1000 AS netns, arg_max(event_type, event_id) AS service_id, 'c-' || max(event_id) AS container_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) GROUP BY user_id",
    "event_decode": f"""SELECT event_id, {EVENT} AS kind, '10.0.0.1:' || (event_id % 65536) || ' -> 10.0.0.2:80' AS shown, CASE WHEN event_id % 2 = 0 THEN '10.1.2.3' ELSE '0.0.0.0' END AS ip,
        CAST(greatest(floor((5000999 - event_id * 1000) / 1000), 0) AS BIGINT) AS duration_us FROM events""",
    "config_decode": """WITH e AS (SELECT event_id, event_id % 4 AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_id, CASE t WHEN 0 THEN 'threshold' WHEN 1 THEN 'anomaly' WHEN 2 THEN 'rate_of_change' END AS rule_type, CASE t WHEN 0 THEN 'error_rate' WHEN 1 THEN 'p95_latency_us' WHEN 2 THEN 'request_count' END AS metric,
            CASE t WHEN 0 THEN '>=' END AS operator, CASE t WHEN 0 THEN CAST(0.5 AS DOUBLE) END AS value, CASE WHEN t IN (0, 2) THEN k END AS window_secs, CASE t WHEN 0 THEN CAST(10 AS BIGINT) END AS min_requests,
            CASE t WHEN 1 THEN CAST(3600 AS BIGINT) END AS baseline_window_secs, CASE t WHEN 1 THEN k END AS evaluation_window_secs, CASE t WHEN 1 THEN CAST(3.5 AS DOUBLE) END AS z_score_threshold, CASE t WHEN 2 THEN CAST(-50 AS DOUBLE) END AS change_threshold_pct FROM e""",
    "id_functions": """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'none' ELSE md5(event_type) END AS trace_id, make_timestamp(1700000000000000 + event_id * 1234567 // 1000) AS begun,
        '10.0.0.2:80 -> 10.0.0.1:' || (event_id % 65536) AS reversed FROM events""",
    "date_keys": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_key, CAST(strftime(ts, '%Y%m') AS INTEGER) AS month_key FROM events",
    "payload_tests": "SELECT page_id, page_id % 3 < 2 AS is_http, CAST(least(2048, page_id % 50 * 100 + CASE page_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 17 ELSE 7 END) AS INTEGER) AS kept FROM pages",
    "service_enrich_left": STEPS + """ SELECT netns, seq, kind, CASE WHEN netns = 1004 THEN 'unknown' ELSE 'proj_demo' END AS project_id,
        CASE netns WHEN 1001 THEN 'svc_api_gateway' WHEN 1002 THEN 'svc_user_service' WHEN 1003 THEN 'svc_payment_service' ELSE 'unknown' END AS service_id, CASE WHEN netns = 1004 THEN 'unknown' ELSE 'production' END AS environment_id,
        CASE netns WHEN 1001 THEN 'c-gateway' WHEN 1002 THEN 'c-user' WHEN 1003 THEN 'c-payment' ELSE 'netns-1004' END AS container_id FROM e""",
    "dst_service_resolve": """SELECT event_id * 16 AS seq, CASE event_id % 3 WHEN 0 THEN '172.17.0.3' WHEN 1 THEN '172.17.0.4' ELSE '172.17.0.5' END AS dst_ip,
        CASE event_id % 3 WHEN 0 THEN 'svc_user_service' WHEN 1 THEN '' ELSE 'svc_db_service' END AS dst_service_id FROM events""",
}

QUERIES = {f.__name__: f for f in (
    route_normalize, traceparent_parse, http_request_parse, http_response_parse, header_parse, netns_parse, docker_event_parse, docker_inspect,
    service_enrich_left, dst_service_resolve, mapping_upsert, mapping_delete_anti, event_decode, config_decode, id_functions, date_keys, payload_tests,
)}
