"""Small expressions over spans, rules and connections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trace_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def trace_from_hex(text: Column) -> Column:
    """16 bytes, or null unless the text is 32 hex digits."""
    return F.when(text.rlike("^[0-9a-fA-F]{32}$"), F.unhex(text))


def derived_trace_id(*parts: Column) -> Column:
    """A trace id made from its cause, so that a retried task makes the same one."""
    return F.md5(F.concat_ws("|", *parts))


def derived_span_id(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def ns_to_timestamp(ns: Column) -> Column:
    """The time of nanoseconds since the epoch, cut to microseconds; whole numbers throughout, as doubles don't hold them."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def duration_us(start_ns: Column, end_ns: Column) -> Column:
    return F.greatest(F.floor((end_ns - start_ns) / 1000), F.lit(0)).cast("bigint")


def stored_ip(ip: Column) -> Column:
    """IPv4 as it is, anything else as the zero address."""
    return F.when(ip.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), ip).otherwise(F.lit("0.0.0.0"))


def reversed_tuple(src_ip: str, src_port: str, dst_ip: str, dst_port: str) -> Column:
    return F.struct(F.col(dst_ip).alias("src_ip"), F.col(dst_port).alias("src_port"), F.col(src_ip).alias("dst_ip"), F.col(src_port).alias("dst_port"))


def shown_tuple(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.format_string("%s:%d -> %s:%d", src_ip, src_port, dst_ip, dst_port)


def bucket(ts: Column, seconds: int = 300) -> Column:
    """Start of the interval that holds the time."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)


def date_keys(ts: Column) -> list[Column]:
    """The day as a date and as a number, and the month as a number: keys of partitions."""
    return [F.to_date(ts).alias("day"), F.date_format(ts, "yyyyMMdd").cast("int").alias("day_key"), F.date_format(ts, "yyyyMM").cast("int").alias("month_key")]


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def compare(operator: Column, value: Column, limit: Column) -> Column:
    return F.when(operator == ">", value > limit).when(operator == "<", value < limit).when(operator == ">=", value >= limit).when(operator == "<=", value <= limit)


def lookback_secs() -> Column:
    """Seconds of history that a rule reads."""
    return F.when(F.col("rule_type") == "threshold", F.col("window_secs")).when(F.col("rule_type") == "anomaly", F.col("baseline_window_secs")).otherwise(2 * F.col("window_secs"))


def fingerprint(rule_id: Column, service_id: Column, severity: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", rule_id, service_id, severity)), 1, 16)


def service_id_of(name: Column) -> Column:
    return F.concat(F.lit("svc_"), F.translate(name, "-", "_"))


def netns_of(link: Column) -> Column:
    """The number in net:[N], null unless it fits 32 bits without sign."""
    number = F.regexp_extract(link, r"^net:\[([0-9]+)\]$", 1)
    value = F.when(F.length(number).between(1, 18), number.try_cast("bigint"))
    return F.when(value <= 4294967295, value)


def docker_event(line: Column) -> Column:
    """struct(action, id) of a start or die line, else null."""
    parts = F.split(F.trim(line), " ", 2)
    return F.when((F.size(parts) == 2) & parts[0].isin("start", "die"), F.struct(parts[0].alias("action"), parts[1].alias("id")))


def event_kind(code: Column) -> Column:
    return F.when(code == 0, "connect").when(code == 1, "accept").when(code == 2, "send").when(code == 3, "recv").otherwise("close")
