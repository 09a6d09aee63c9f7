"""Spans and events from the star-schema tables that tests and benches read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import http


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPAN_COLUMNS = [
    "trace_id", "span_id", "parent_span_id", "project_id", "service_id", "environment_id", "http_method", "http_path", "http_route",
    "http_status", "start_time", "duration_us", "dst_service_id", "is_error", "is_root", "arrival_seq",
]


def _completed(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "environment_id": F.lit("production"),
        "http_route": http.normalize_route(F.col("http_path")),
        "is_error": F.col("http_status") >= 400,
        "is_root": F.col("parent_span_id") == 0,
        "arrival_seq": F.col("span_id"),
    }).select(*SPAN_COLUMNS)


def root_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root span per order; no shuffle."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return _completed(o.select(
        F.md5(key.cast("string")).alias("trace_id"),
        (key * 1000 + 1).alias("span_id"),
        F.lit(0).cast("bigint").alias("parent_span_id"),
        F.when(F.col("o_custkey") % 10 == 0, "proj_other").otherwise("proj_demo").alias("project_id"),
        F.lit("svc_api_gateway").alias("service_id"),
        F.when(F.col("o_orderstatus") == "O", "GET").when(F.col("o_orderstatus") == "P", "POST").otherwise("PUT").alias("http_method"),
        F.concat(F.lit("/api/orders/"), key.cast("string")).alias("http_path"),
        F.when(key % 20 == 0, 500).otherwise(200).alias("http_status"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))).alias("start_time"),
        F.floor("o_totalprice").cast("bigint").alias("duration_us"),
        F.concat(F.lit("svc_s"), (F.col("o_custkey") % 8).cast("string")).alias("dst_service_id"),
    ))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per event over 30 days; a user's events are a trace, in which each has one of the last three before it as parent."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    back = F.least(k - 1, F.lit(1) + F.col("event_id") % 3).cast("int")
    own = Window.partitionBy("user_id").orderBy("event_id")
    parent = F.when(back == 1, F.lag("event_id", 1).over(own)).when(back == 2, F.lag("event_id", 2).over(own)).when(back == 3, F.lag("event_id", 3).over(own))
    return _completed(e.select(
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        (F.col("event_id") + 1).alias("span_id"),
        F.coalesce(parent + 1, F.lit(0)).cast("bigint").alias("parent_span_id"),
        F.lit("proj_demo").alias("project_id"),
        F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("service_id"),
        F.lit("GET").alias("http_method"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("http_path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_us"),
        F.lit("").alias("dst_service_id"),
    ))


def child_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One child span per order line, numbered within its order."""
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    every = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    own = Window.partitionBy("l_orderkey").orderBy(*every)
    joined = line.withColumn("rn", F.row_number().over(own)).join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_orderkey")
    begin = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=((key % 86400) + F.col("rn") / 1000).cast("decimal(18,6)"))
    return _completed(joined.select(
        F.md5(key.cast("string")).alias("trace_id"),
        (key * 1000 + 1 + F.col("rn")).alias("span_id"),
        (key * 1000 + 1).alias("parent_span_id"),
        F.when(F.col("o_custkey") % 10 == 0, "proj_other").otherwise("proj_demo").alias("project_id"),
        F.concat(F.lit("svc_s"), (F.col("l_suppkey") % 8).cast("string")).alias("service_id"),
        F.lit("GET").alias("http_method"),
        F.concat(F.lit("/internal/parts/"), F.col("l_partkey").cast("string")).alias("http_path"),
        F.when(F.col("l_returnflag") == "R", 500).otherwise(200).alias("http_status"),
        begin.alias("start_time"),
        F.floor("l_extendedprice").cast("bigint").alias("duration_us"),
        F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("svc_db"), (F.col("l_partkey") % 3).cast("string"))).alias("dst_service_id"),
    ))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_spans(spark, sf_dir).unionByName(child_spans(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service observations from events; the clock is compressed to one bucket per hour (sec counts hours)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("proj_demo").alias("project_id"),
        F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("service_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("bigint").alias("sec"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_us"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("event_id").alias("arrival_seq"),
    )


def trace_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit("proj_demo").alias("project_id"),
        F.concat(F.lit("svc_"), F.col("role")).alias("service_id"),
        F.md5(F.col("conv_id").cast("string")).alias("trace_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("span_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn")).alias("timestamp"),
        F.when(F.col("role") == "user", "INFO").otherwise("DEBUG").alias("log_level"),
        F.md5("text").alias("message"),
    )


#: Namespaces of the demo services, and which of them call which.
PATTERNS = [(1001, 1002, "172.17.0.2", "172.17.0.3", 8001), (1001, 1003, "172.17.0.2", "172.17.0.4", 8002), (1002, 1004, "172.17.0.3", "172.17.0.5", 8004)]


def mapping(spark: SparkSession) -> DataFrame:
    """Namespace to service, for three of the four demo services; the fourth stays unknown."""
    rows = [(1001, "proj_demo", "svc_api_gateway", "api-gateway", "production", "c-gateway"), (1002, "proj_demo", "svc_user_service", "user-service", "production", "c-user"), (1003, "proj_demo", "svc_payment_service", "payment-service", "production", "c-payment")]
    return spark.createDataFrame(rows, "netns long, project_id string, service_id string, service_name string, environment_id string, container_id string")


def tcp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven TCP events of each request: connect, accept, request out and in, response out and in, close.

    Every 11th request is never answered; every 13th sends a second request before the answers.
    """
    e = table(spark, sf_dir, "events").withColumn("p", (F.col("event_id") % 3).cast("int"))
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PATTERNS]), F.col("p") + 1)
    e = e.withColumns({
        "client": pick(0).cast("bigint"), "server": pick(1).cast("bigint"), "src_ip": pick(2), "dst_ip": pick(3), "dst_port": pick(4),
        "src_port": (F.lit(40000) + F.col("event_id") % 20001).cast("int"),
        "t0": F.unix_micros(F.col("ts").cast("timestamp")) * 1000,
        "latency": F.lit(5000) + F.floor(F.col("value") * 100).cast("bigint"),
        "request": F.concat(F.lit("GET /"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: demo\r\n\r\n")),
        "second": F.concat(F.lit("POST /again/"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: demo\r\n\r\n")),
        "response": F.concat(F.lit("HTTP/1.1 "), F.when(F.col("event_type") == "error", "500 Error").otherwise("200 OK"), F.lit("\r\n\r\n")),
    })
    answered, twice = F.col("event_id") % 11 != 0, F.col("event_id") % 13 == 0
    step = lambda k, kind, side, offset, payload, keep: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.col(side).alias("netns"), offset.cast("bigint").alias("offset"), payload.alias("payload"), keep.alias("keep"))
    none, yes, end = F.lit(""), F.lit(True), F.col("latency")
    steps = F.array(
        step(0, "connect", "client", F.lit(0), none, yes), step(1, "accept", "server", F.lit(100), none, yes),
        step(2, "send", "client", F.lit(200), F.col("request"), yes), step(3, "recv", "server", F.lit(300), F.col("request"), yes),
        step(4, "send", "client", F.lit(400), F.col("second"), twice), step(5, "recv", "server", F.lit(500), F.col("second"), twice),
        step(6, "send", "server", end - 400, F.col("response"), answered), step(7, "recv", "client", end - 300, F.col("response"), answered),
        step(8, "send", "server", end - 200, F.col("response"), answered & twice), step(9, "recv", "client", end - 100, F.col("response"), answered & twice),
        step(10, "close", "client", end, none, yes),
    )
    x = e.select("event_id", "t0", "src_ip", "src_port", "dst_ip", "dst_port", F.explode(F.filter(steps, lambda s: s["keep"])).alias("s"))
    return x.select(
        (F.col("event_id") * 16 + F.col("s.k")).alias("seq"),
        (F.col("t0") + F.col("s.offset") * 1000).alias("timestamp_ns"),
        "s.netns", "s.kind", "src_ip", "src_port", "dst_ip", "dst_port",
        F.encode("s.payload", "UTF-8").alias("payload"),
    )


BURST = 70  # requests of a burst, over the cap of 64


def unusual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP events of connections that need the walk, one of every 40th event, in three shapes.

    0: BURST requests, then as many answers. 1: a request seen in three namespaces, answered in each.
    2: a chain on one 4-tuple: a request out and in, one back out and in, no answer, a close.
    """
    e = table(spark, sf_dir, "events").where("event_id % 40 = 0").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t0"), (F.col("event_id") / 40).cast("bigint").alias("k"))
    ask = lambda path: F.concat(F.lit("GET /"), path, F.lit(" HTTP/1.1\r\nHost: demo\r\n\r\n"))
    ok = F.lit("HTTP/1.1 200 OK\r\n\r\n")
    step = lambda i, ns, kind, payload: F.struct(i.cast("bigint").alias("i"), F.lit(ns).cast("bigint").alias("netns"), F.lit(kind).alias("kind"), payload.alias("payload"))
    burst = lambda first, kind, payload: F.transform(F.sequence(F.lit(1), F.lit(BURST)), lambda i: step(i + first, 1001, kind, payload(i)))
    listed = lambda *rows: F.array(*[step(F.lit(i + 1), *row) for i, row in enumerate(rows)])
    a, b, none = ask(F.lit("a")), ask(F.lit("b")), F.lit("")
    shapes = (
        F.concat(burst(0, "send", lambda i: ask(i.cast("string"))), burst(BURST, "recv", lambda i: ok)),
        listed((1001, "send", a), (1002, "recv", a), (1003, "recv", a), (1003, "send", ok), (1002, "send", ok), (1001, "recv", ok)),
        listed((1001, "send", a), (1002, "recv", a), (1002, "send", b), (1001, "recv", b), (1001, "close", none)),
    )
    shape = F.col("k") % 3
    x = e.select("event_id", "t0", "k", F.explode(F.when(shape == 0, shapes[0]).when(shape == 1, shapes[1]).otherwise(shapes[2])).alias("s"))
    return x.select(
        (F.col("event_id") * 1000 + F.col("s.i")).alias("seq"), (F.col("t0") + F.col("s.i") * 10_000).alias("timestamp_ns"), "s.netns", "s.kind",
        F.lit("10.9.0.1").alias("src_ip"), (F.lit(1024) + F.col("k")).cast("int").alias("src_port"), F.lit("10.9.0.2").alias("dst_ip"), F.lit(80).alias("dst_port"),
        F.encode("s.payload", "UTF-8").alias("payload"),
    )
