"""Captured TCP records: fixed-size headers with a payload, and what is missing in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.spans import event_kind

#: Fields of a record: name, first byte (from 1), bytes, whether the most significant byte comes first.
LAYOUT = [
    ("timestamp_ns", 1, 8, False), ("pid", 9, 4, False), ("netns", 13, 4, False), ("fd", 17, 4, False), ("src_addr", 21, 4, True), ("dst_addr", 25, 4, True),
    ("src_port", 29, 2, False), ("dst_port", 31, 2, False), ("kind_code", 33, 4, False), ("payload_len", 37, 4, False),
]
HEADER = 40
CAPTURED = 2048


def _number(raw: Column, at: int, size: int, big_endian: bool) -> Column:
    digits = F.hex(F.substring(raw, at, size))
    if not big_endian:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(digits, 16, -10).cast("bigint")


def _dotted(raw: Column, at: int) -> Column:
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(raw, at + k, 1)), 16, 10) for k in range(4)])


def decoded(records: DataFrame, column: str = "record") -> DataFrame:
    """Event columns of binary records; short records are left out, payloads end at their stated length."""
    raw = F.col(column)
    fields = {n: _number(raw, a, s, b) for n, a, s, b in LAYOUT if not n.endswith("_addr")}
    out = records.where(F.octet_length(raw) >= HEADER).withColumns(fields | {"src_ip": _dotted(raw, 21), "dst_ip": _dotted(raw, 25)})
    size = F.least(F.col("payload_len"), F.lit(CAPTURED)).cast("int")
    whole = (F.col("payload_len") > 0) & (F.octet_length(raw) > HEADER)
    return out.withColumns({"kind": event_kind(F.col("kind_code")), "payload": F.when(whole, F.substring(raw, F.lit(HEADER + 1), size)).otherwise(F.unhex(F.lit("")))}).drop(column, "kind_code", "payload_len")


def with_addresses(events: DataFrame) -> DataFrame:
    """Events with a payload but without addresses take the last ones of their process."""
    real = (F.col("src_ip") != "0.0.0.0") & (F.col("dst_ip") != "0.0.0.0")
    past = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(real, F.struct("src_ip", "src_port", "dst_ip", "dst_port")), ignorenulls=True).over(past)
    fill = ~real & (F.coalesce(F.octet_length("payload"), F.lit(0)) > 0) & F.col("_last").isNotNull()
    out = events.withColumn("_last", last)
    return out.withColumns({c: F.when(fill, F.col(f"_last.{c}")).otherwise(F.col(c)) for c in ("src_ip", "src_port", "dst_ip", "dst_port")}).drop("_last")


def with_netns(events: DataFrame, processes: DataFrame) -> DataFrame:
    """A namespace of 0 is looked up by process; what isn't known stays 0."""
    known = processes.select("pid", F.col("netns").alias("_known"))
    return events.join(known, "pid", "left").withColumn("netns", F.coalesce(F.nullif("netns", F.lit(0)), F.col("_known"), F.lit(0).cast("bigint"))).drop("_known")
