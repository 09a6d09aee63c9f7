"""Traces: lookup, waterfall, summaries and search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATERFALL = ["trace_id", "span_id", "parent_span_id", "service_id", "http_method", "http_path", "http_status", "start_time", "duration_us", "is_error"]
DETAIL = [*WATERFALL[:6], "http_route", *WATERFALL[6:]]


def detail_rows(spans: DataFrame) -> DataFrame:
    """Spans as detail rows; a blank route is made from the path."""
    from tracewell.functions.http import normalize_route

    route = F.when(F.coalesce(F.col("http_route"), F.lit("")) == "", normalize_route(F.col("http_path"))).otherwise(F.col("http_route"))
    return spans.withColumn("http_route", route).select(*DETAIL)


def waterfall(spans: DataFrame, project: str, trace_id: str) -> DataFrame:
    """The spans of a trace by start time; a point lookup that reaches the scan."""
    return spans.where((F.col("project_id") == project) & (F.col("trace_id") == trace_id)).select(*WATERFALL).orderBy("start_time", "span_id")


def slow_roots(spans: DataFrame, project: str, service: str, since: datetime, over_us: int = 500_000, limit: int = 50) -> DataFrame:
    found = spans.where((F.col("project_id") == project) & (F.col("service_id") == service) & (F.col("start_time") >= F.lit(since)) & (F.col("duration_us") > over_us) & F.col("is_root"))
    return found.select("trace_id", "service_id", "http_method", "http_path", "http_status", "duration_us", "start_time", "is_error").orderBy(F.desc("duration_us"), "trace_id").limit(limit)


def summaries(spans: DataFrame, **flags: Column) -> DataFrame:
    """One row per trace: its root (the first span without a parent, else the first), longest span, size and errors, and for each flag whether it holds for some span."""
    root = F.min_by(F.struct("service_id", "http_path", "http_method", "start_time"), F.struct(F.col("parent_span_id") != 0, "arrival_seq"))
    return spans.groupBy("project_id", "trace_id").agg(
        root.alias("root"), F.max("duration_us").alias("total_duration_us"), F.count(F.lit(1)).alias("span_count"), F.bool_or("is_error").alias("has_error"), *[F.bool_or(c).alias(k) for k, c in flags.items()],
    ).select("project_id", "trace_id", F.col("root.service_id").alias("root_service"), F.col("root.http_path").alias("root_path"), F.col("root.http_method").alias("root_method"), "total_duration_us", "span_count", "has_error", F.col("root.start_time").alias("start_time"), *flags)


SUMMARY = ["trace_id", "root_service", "root_path", "root_method", "total_duration_us", "span_count", "has_error", "start_time"]


def _of(spans: DataFrame, project: str, since: datetime | None, until: datetime | None) -> DataFrame:
    found = spans.where(F.col("project_id") == project)
    if since is not None:
        found = found.where(F.col("start_time") >= F.lit(since))
    return found if until is None else found.where(F.col("start_time") <= F.lit(until))


def list_traces(spans: DataFrame, project: str, service: str | None = None, route: str | None = None, errors_only: bool = False, min_duration_us: int | None = None, limit: int = 50, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Latest traces with some span of the service, of the route and with an error, as asked for."""
    asked = {"of_service": ("service_id", service), "of_route": ("http_route", route)}
    flags = {k: F.col(c) == x for k, (c, x) in asked.items() if x is not None}
    found = summaries(_of(spans, project, since, until), **flags)
    for flag in [*flags, *["has_error"] * errors_only]:
        found = found.where(flag)
    if min_duration_us is not None:
        found = found.where(F.col("total_duration_us") >= min_duration_us)
    return found.select(*SUMMARY).orderBy(F.desc("start_time"), "trace_id").limit(limit)


def trace_detail(spans: DataFrame, project: str, trace_id: str) -> DataFrame:
    """One row: longest span, size, errors and the spans in arrival order. No row: no such trace."""
    found = spans.where((F.col("project_id") == project) & (F.col("trace_id") == trace_id))
    rows = F.array_sort(F.collect_list(F.struct("arrival_seq", *[c for c in DETAIL if c != "trace_id"])))
    return found.groupBy("trace_id").agg(F.max("duration_us").alias("total_duration_us"), F.count(F.lit(1)).alias("span_count"), F.bool_or("is_error").alias("has_error"), rows.alias("spans"))


def metric_to_traces(spans: DataFrame, project: str, service: str, metric: str, min_duration_us: int | None = None, limit: int = 50, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The slowest traces with a span of the service; for error_rate those with an error."""
    found = summaries(_of(spans, project, since, until), of_service=F.col("service_id") == service).where("of_service")
    if metric == "error_rate":
        found = found.where("has_error")
    if min_duration_us is not None:
        found = found.where(F.col("total_duration_us") >= min_duration_us)
    return found.select(*SUMMARY).orderBy(F.desc("total_duration_us"), "trace_id").limit(limit)


def spike_spans(spans: DataFrame, project: str, service: str, start: datetime, stop: datetime, over_us: int, limit: int = 20) -> DataFrame:
    found = spans.where((F.col("project_id") == project) & (F.col("service_id") == service) & F.col("start_time").between(F.lit(start), F.lit(stop)) & (F.col("duration_us") > over_us))
    return found.select("trace_id", "span_id", "service_id", "http_method", "http_path", "http_status", "duration_us", "start_time").orderBy(F.desc("duration_us"), "trace_id", "span_id").limit(limit)


def spike_join(spans: DataFrame, rollup: DataFrame) -> DataFrame:
    """Spans slower than the p99 of their own service and five-minute window, from the roll-up."""
    from tracewell.functions.spans import bucket

    keyed = spans.withColumn("window_start", bucket(F.col("start_time")))
    limits = rollup.select("project_id", "service_id", "window_start", "p99_us")
    return keyed.join(limits, ["project_id", "service_id", "window_start"]).where("duration_us > p99_us").select("project_id", "service_id", "window_start", "trace_id", "span_id", "duration_us")


def trace_logs(logs: DataFrame, project: str, trace_id: str) -> DataFrame:
    return logs.where((F.col("project_id") == project) & (F.col("trace_id") == trace_id)).select("service_id", "timestamp", "log_level", "message", "span_id").orderBy("timestamp", "span_id")


def synthesised_logs(spans: DataFrame, project: str, trace_id: str) -> DataFrame:
    """One log line per span of a trace."""
    found = spans.where((F.col("project_id") == project) & (F.col("trace_id") == trace_id))
    text = F.concat(F.col("http_method"), F.lit(" "), F.col("http_path"), F.lit(" → "), F.col("http_status").cast("string"), F.lit(" ("), F.col("duration_us").cast("string"), F.lit("µs)"))
    return found.select("service_id", "span_id", F.col("start_time").alias("timestamp"), F.when(F.col("is_error"), "ERROR").otherwise("INFO").alias("log_level"), text.alias("message")).orderBy("timestamp", "span_id")


def parent_links(spans: DataFrame) -> DataFrame:
    """Extension: each child with its parent's service and the wait before it began."""
    parent = spans.select(F.col("trace_id").alias("pt"), F.col("span_id").alias("ps"), F.col("service_id").alias("parent_service"), F.col("start_time").alias("parent_start"))
    child = spans.where("parent_span_id <> 0")
    return child.join(parent, (F.col("trace_id") == F.col("pt")) & (F.col("parent_span_id") == F.col("ps"))).select("trace_id", "span_id", "parent_service", "service_id", (F.unix_micros("start_time") - F.unix_micros("parent_start")).alias("offset_us"))
