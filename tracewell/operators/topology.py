"""Service dependencies: five-minute edges, the graph over a time and its nodes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import bucket, ratio


def edges(spans: DataFrame) -> DataFrame:
    """Calls, errors and durations per caller, callee and five-minute window; summed rows sum on."""
    known = spans.where("dst_service_id <> ''").withColumn("window_start", bucket(F.col("start_time")))
    return known.groupBy("project_id", "environment_id", F.col("service_id").alias("caller_service_id"), F.col("dst_service_id").alias("callee_service_id"), "window_start").agg(
        F.count(F.lit(1)).alias("call_count"), F.count_if("is_error").alias("error_count"), F.sum("duration_us").alias("total_duration_us"), F.count(F.lit(1)).alias("duration_count"),
    )


def graph(edge_rows: DataFrame, project: str, since: datetime) -> DataFrame:
    found = edge_rows.where((F.col("project_id") == project) & (F.col("window_start") >= F.lit(since)))
    sums = found.groupBy("caller_service_id", "callee_service_id").agg(F.sum("call_count").alias("total_calls"), F.sum("error_count").alias("total_errors"), F.sum("total_duration_us").alias("d"), F.sum("duration_count").alias("n"))
    return sums.select("caller_service_id", "callee_service_id", "total_calls", "total_errors", ratio(F.col("total_errors"), F.col("total_calls")).alias("error_rate"), (F.col("d") / F.col("n")).alias("avg_duration_us")).orderBy(F.desc("total_calls"), "caller_service_id", "callee_service_id")


def live_edges(spans: DataFrame) -> DataFrame:
    """Edges as the collector keeps them: none from a service to itself, with the mean duration."""
    known = spans.where("dst_service_id <> '' AND service_id <> dst_service_id")
    return known.groupBy(F.col("service_id").alias("caller"), F.col("dst_service_id").alias("callee")).agg(F.count(F.lit(1)).alias("call_count"), F.count_if("is_error").alias("error_count"), F.avg("duration_us").alias("avg_duration_us"))


def nodes(edge_rows: DataFrame) -> DataFrame:
    """Every caller and callee with its outgoing calls; rates of a node are not kept and are zero."""
    callers = edge_rows.select(F.col("caller").alias("service_id"), "call_count")
    callees = edge_rows.select(F.col("callee").alias("service_id"), F.lit(0).cast("bigint").alias("call_count"))
    return callers.unionAll(callees).groupBy("service_id").agg(F.sum("call_count").alias("request_count")).withColumns({"error_rate": F.lit(0.0), "p99_latency_us": F.lit(0.0)})


def resolve_callee(spans: DataFrame, addresses: DataFrame) -> DataFrame:
    """dst_service_id from a table of addresses (ip, service_id); unknown ones stay empty."""
    known = addresses.select(F.col("ip").alias("_ip"), F.col("service_id").alias("_callee"))
    return spans.join(known, F.col("dst_ip") == F.col("_ip"), "left").withColumn("dst_service_id", F.coalesce("_callee", F.lit(""))).drop("_ip", "_callee")
