"""Five-minute metrics per route: exact, or with mergeable quantile sketches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.spans import bucket, ratio

KEYS = ["project_id", "service_id", "environment_id", "http_route", "http_method", "window_start"]
#: Columns of spans that a roll-up reads.
READS = [*KEYS[:-1], "start_time", "duration_us", "is_error"]
QUANTILES = {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.count_if("is_error").alias("error_count"),
        F.sum("duration_us").alias("total_duration_us"),
        F.min("duration_us").alias("min_us"),
        F.max("duration_us").alias("max_us"),
    ]


def windowed(spans: DataFrame, seconds: int = 300) -> DataFrame:
    return spans.withColumn("window_start", bucket(F.col("start_time"), seconds))


def exact(spans: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counters and exact quantiles per key, from raw spans."""
    quantiles = [F.percentile("duration_us", q).alias(name) for name, q in QUANTILES.items()]
    return windowed(spans).groupBy(*keys).agg(*_counters(), *quantiles)


def partial(spans: DataFrame, k: int = 200) -> DataFrame:
    """Counters and a quantile sketch per key: what is stored, and merges with itself."""
    return windowed(spans).groupBy(*KEYS).agg(*_counters(), F.kll_sketch_agg_bigint("duration_us", F.lit(k)).alias("sketch"))


def remerged(stored: DataFrame, parts: int | None = None) -> DataFrame:
    """Stored partial rows with one row a key, partial still.

    parts: rows are dealt by key into so many before they are merged, as a map task would sort all its
    sketches for little: a key has one row a folder at most.
    """
    if parts is not None:
        stored = stored.repartition(parts, *KEYS)
    sums = [F.sum(c).alias(c) for c in ("request_count", "error_count", "total_duration_us")]
    return stored.groupBy(*KEYS).agg(*sums, F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored partial rows, merged to coarser keys."""
    sums = [F.sum(c).alias(c) for c in ("request_count", "error_count", "total_duration_us")]
    out = stored.groupBy(*keys).agg(*sums, F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return out.withColumns({name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).cast("double") for name, q in QUANTILES.items()}).drop("sketch")


def recounted(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of roll-up rows, merged to coarser keys."""
    return rollup.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("request_count", "error_count", "total_duration_us")], F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"))


def service_metrics(spans: DataFrame, project: str, service: str, since: datetime) -> DataFrame:
    """Series of one service: counts, error rate, quantiles and extremes per window."""
    mine = spans.where((F.col("project_id") == project) & (F.col("service_id") == service) & (F.col("start_time") >= F.lit(since)))
    out = exact(mine, ["window_start"]).withColumn("error_rate", ratio(F.col("error_count"), F.col("request_count")))
    return out.select("window_start", "request_count", "error_count", "error_rate", *QUANTILES, "min_us", "max_us").orderBy("window_start")


def top_endpoints(spans: DataFrame, project: str, service: str, since: datetime, limit: int = 20) -> DataFrame:
    mine = spans.where((F.col("project_id") == project) & (F.col("service_id") == service) & (F.col("start_time") >= F.lit(since)))
    out = exact(mine, ["http_route", "http_method"])
    return out.select("http_route", "http_method", "request_count", "error_count", "p99_us").orderBy(F.desc("request_count"), "http_route", "http_method").limit(limit)


def error_rate_by_service(spans: DataFrame, project: str, since: datetime) -> DataFrame:
    mine = spans.where((F.col("project_id") == project) & (F.col("start_time") >= F.lit(since)))
    out = exact(mine, ["service_id"])
    return out.select("service_id", F.col("request_count").alias("requests"), F.col("error_count").alias("errors"), ratio(F.col("error_count"), F.col("request_count")).alias("error_rate"), "p99_us").orderBy(F.desc("error_rate"), "service_id")


def _stored_of(stored: DataFrame, project: str, since: datetime, service: str | None = None) -> DataFrame:
    mine = stored.where((F.col("project_id") == project) & (F.col("window_start") >= F.lit(since)))
    return mine if service is None else mine.where(F.col("service_id") == service)


def service_metrics_stored(stored: DataFrame, project: str, service: str, since: datetime) -> DataFrame:
    """service_metrics from stored partial rows: sketches are merged, so that no task holds a group's durations; quantiles have the sketch's error."""
    out = merged(_stored_of(stored, project, since, service), ["window_start"]).withColumn("error_rate", ratio(F.col("error_count"), F.col("request_count")))
    return out.select("window_start", "request_count", "error_count", "error_rate", *QUANTILES, "min_us", "max_us").orderBy("window_start")


def top_endpoints_stored(stored: DataFrame, project: str, service: str, since: datetime, limit: int = 20) -> DataFrame:
    out = merged(_stored_of(stored, project, since, service), ["http_route", "http_method"])
    return out.select("http_route", "http_method", "request_count", "error_count", "p99_us").orderBy(F.desc("request_count"), "http_route", "http_method").limit(limit)


def error_rate_by_service_stored(stored: DataFrame, project: str, since: datetime) -> DataFrame:
    out = merged(_stored_of(stored, project, since), ["service_id"])
    return out.select("service_id", F.col("request_count").alias("requests"), F.col("error_count").alias("errors"), ratio(F.col("error_count"), F.col("request_count")).alias("error_rate"), "p99_us").orderBy(F.desc("error_rate"), "service_id")


def retained(df: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    """Rows that a retention of some days keeps."""
    return df.where(F.col(column) >= F.lit(as_of) - F.make_dt_interval(days=F.lit(days)))
