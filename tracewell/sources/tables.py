"""The stored tables of spans, logs, roll-ups and edges: layout, reading, choice of files, retention.

A table is versioned (versions.py): every append is a folder with day folders in it, and a
side table, <path>/_files, has for each file its day, the least and greatest value of the
columns it is sorted by, and a Bloom filter of its trace ids as bitmaps. A lookup asks the side
table first and scans the files that can hold a row; nothing else is opened. Retention hides
days in one version, then deletes their folders; if it stops in between, the next run finishes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources import versions


@dataclass(frozen=True)
class Layout:
    """time: the column of the day; sort: order within files; bloom: the column looked up by value, if any; days kept."""

    time: str
    sort: tuple[str, ...]
    bloom: str | None
    days: int


LAYOUTS = {
    "spans": Layout("start_time", ("project_id", "service_id", "start_time", "trace_id"), "trace_id", 7),
    "trace_logs": Layout("timestamp", ("project_id", "service_id", "timestamp", "trace_id"), "trace_id", 7),
    "rollup": Layout("window_start", ("project_id", "service_id", "http_route", "http_method", "window_start"), None, 90),
    "dependencies": Layout("window_start", ("project_id", "caller_service_id", "callee_service_id", "window_start"), None, 30),
}
#: Columns that folders stand for.
PLACE = T.StructType().add("_rows", "string").add("_date", "date")
#: Days that each table keeps.
RETENTION_DAYS = {k: x.days for k, x in LAYOUTS.items()}
#: Bits of a file's filter, in bitmaps of 32,768, and bits set by a value.
BLOOM_BITS, BLOOM_HASHES = 1 << 20, 4
#: Most files that a lookup names one by one; beyond them the table is scanned with its filters.
MOST_FILES = 20_000


def stored_rows(spans: DataFrame) -> DataFrame:
    """Spans as rows of the table: times in microseconds, IPv4 or the zero address, the day as partition."""
    from tracewell.functions.http import normalize_route
    from tracewell.functions.spans import stored_ip

    out = spans.withColumn("http_route", F.when(F.coalesce("http_route", F.lit("")) != "", F.col("http_route")).otherwise(normalize_route(F.col("http_path"))))
    for c in ("src_ip", "dst_ip"):
        if c in out.columns:
            out = out.withColumn(c, stored_ip(F.col(c)))
    return out.withColumn("_date", F.to_date("start_time"))


def _bits(value: Column) -> list[Column]:
    """Positions (from 1) of a value's bits; a null has none."""
    return [F.when(value.isNotNull(), F.pmod(F.xxhash64(value, F.lit(k)), F.lit(BLOOM_BITS)) + 1) for k in range(BLOOM_HASHES)]


def _files_side(spark: SparkSession, path: str) -> str:
    return f"{path.rstrip('/')}/_files"


def _described(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row a file with its ranges, and one a bitmap of its filter."""
    named = rows.withColumn("_file", F.col("_metadata.file_path"))
    ranges = F.map_from_arrays(F.array(*[F.lit(c) for c in layout.sort]), F.array(*[F.struct(text_of(layout, F.min(c), c).alias("low"), text_of(layout, F.max(c), c).alias("high")) for c in layout.sort]))
    files = named.groupBy("_file").agg(F.first("_date").alias("day"), F.count(F.lit(1)).alias("rows"), ranges.alias("ranges")).withColumnRenamed("_file", "file")
    empty = files.withColumns({"bucket": F.lit(None).cast("bigint"), "bitmap": F.lit(None).cast("binary")})
    if layout.bloom is None:
        return empty
    bits = named.select("_file", F.col("_date").alias("day"), F.explode(F.array(*_bits(F.col(layout.bloom)))).alias("bit")).where("bit IS NOT NULL")
    maps = bits.groupBy(F.col("_file").alias("file"), "day", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    return empty.unionByName(maps, allowMissingColumns=True)


def text_of(layout: Layout, value: Column, column: str) -> Column:
    """A value of a sort column as text that compares like it: times as digits of microseconds, from year 1 on."""
    if column in (layout.time,):
        return F.lpad((F.unix_micros(value) + F.lit(10**17)).cast("string"), 18, "0")
    return value.cast("string")


def _text(layout: Layout, value: Any, column: str, spark: SparkSession) -> str:
    return spark.range(1).select(text_of(layout, F.lit(value), column)).first()[0]


def write(rows: DataFrame, path: str, table: str, shards: int = 16) -> versions.Version:
    """Append rows as one version: a folder a day, of shards files each at most, and what the side table says of them."""
    spark, layout = rows.sparkSession, LAYOUTS[table]
    name = f"_rows={versions.fresh(table)}"
    at = f"{path.rstrip('/')}/{name}"
    dated = rows if "_date" in rows.columns else rows.withColumn("_date", F.to_date(layout.time))
    # Files of a day are told apart by the column that lookups name, others by tenant and service.
    key = F.xxhash64(layout.bloom) if layout.bloom else F.xxhash64(*layout.sort[:2])
    ordered = dated.repartition("_date", F.pmod(key, F.lit(shards))).sortWithinPartitions("_date", *layout.sort)
    writer = ordered.write.partitionBy("_date")
    if layout.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{layout.bloom}", "true").option(f"parquet.bloom.filter.expected.ndv#{layout.bloom}", "100000")
    writer.parquet(at)
    schema = T.StructType([f for f in ordered.schema if f.name != "_date"])
    written = spark.read.schema(T.StructType([*schema, *PLACE])).option("basePath", path).parquet(at)
    _described(written, layout).repartition("day").write.parquet(f"{_files_side(spark, path)}/{name}")
    while True:
        former = versions.version(spark, path)
        try:
            return versions.commit(spark, path, former, [*former.folders, name], former.notes | {"schema": schema.jsonValue()})
        except versions.Conflict:
            continue


def _scanned(spark: SparkSession, path: str, made: versions.Version, names: list[str]) -> DataFrame:
    """Folders or files of a version as a table, hidden days left out."""
    schema = T.StructType([*T.StructType.fromJson(made.notes["schema"]), *PLACE])
    df = spark.read.schema(schema).option("basePath", path).parquet(*names).drop("_rows")
    return _shown(spark, df, made)


def _shown(spark: SparkSession, df: DataFrame, made: versions.Version) -> DataFrame:
    hidden = made.notes.get("hidden_before")
    return df if hidden is None else df.where(F.col("_date") >= F.lit(date.fromisoformat(hidden)))


def read(spark: SparkSession, path: str, table: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows of a time; days are pruned as folders before files are read."""
    made = versions.version(spark, path)
    if not made.folders:
        raise FileNotFoundError(f"{path}: no version of a table")
    df = _scanned(spark, path, made, versions.paths(path, made))
    time = LAYOUTS[table].time
    if since is not None:
        df = df.where((F.col("_date") >= F.lit(since.date())) & (F.col(time) >= F.lit(since)))
    if until is not None:
        df = df.where((F.col("_date") <= F.lit(until.date())) & (F.col(time) <= F.lit(until)))
    return df


def files(spark: SparkSession, path: str, table: str, equal: dict[str, Any], since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Files that can hold rows with those values in that time, by the side table: file, day, rows."""
    made, layout = versions.version(spark, path), LAYOUTS[table]
    side = spark.read.parquet(*[f"{_files_side(spark, path)}/{f}" for f in made.folders])
    hidden = made.notes.get("hidden_before")
    if hidden is not None:
        side = side.where(F.col("day") >= F.lit(date.fromisoformat(hidden)))
    if since is not None:
        side = side.where(F.col("day") >= F.lit(since.date()))
    if until is not None:
        side = side.where(F.col("day") <= F.lit(until.date()))
    found = side.where("bucket IS NULL")
    bounds = {c: (v, v) for c, v in equal.items() if c in layout.sort}
    if since is not None or until is not None:
        bounds[layout.time] = (since, until)
    for c, (low, high) in bounds.items():
        own = F.col("ranges")[c]
        if low is not None:
            found = found.where(own["high"] >= _text(layout, low, c, spark))
        if high is not None:
            found = found.where(own["low"] <= _text(layout, high, c, spark))
    found = found.select("file", "day", "rows")
    if layout.bloom is None or equal.get(layout.bloom) is None:
        return found
    bits = spark.range(1).select(*[x.alias(f"b{k}") for k, x in enumerate(_bits(F.lit(equal[layout.bloom])))]).first()
    wanted = sorted({((b - 1) // 32768 + 1, (b - 1) % 32768) for b in bits})
    byte = lambda at: F.conv(F.hex(F.substring("bitmap", at // 8 + 1, 1)), 16, 10).cast("int")
    is_set = F.lit(0)
    for bucket, at in wanted:
        is_set = is_set + F.when((F.col("bucket") == bucket) & (byte(at).bitwiseAND(F.lit(1 << at % 8)) > 0), 1).otherwise(0)
    holds = side.where(F.col("bucket").isin([b for b, _ in wanted])).groupBy("file").agg(F.sum(is_set).alias("bits")).where(F.col("bits") == len(wanted)).select("file")
    return found.join(holds, "file", "left_semi")


def lookup(spark: SparkSession, path: str, table: str, equal: dict[str, Any], since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows with those values in that time, from the files that can hold them."""
    made, column = versions.version(spark, path), LAYOUTS[table].time
    chosen = [r["file"] for r in files(spark, path, table, equal, since, until).select("file").limit(MOST_FILES + 1).collect()]
    if len(chosen) > MOST_FILES:
        found = read(spark, path, table, since, until)
    else:
        found = _scanned(spark, path, made, chosen) if chosen else read(spark, path, table).where(F.lit(False))
        found = found if since is None else found.where(F.col(column) >= F.lit(since))
        found = found if until is None else found.where(F.col(column) <= F.lit(until))
    for c, v in equal.items():
        found = found.where(F.col(c) == F.lit(v))
    return found


def write_spans(spans: DataFrame, path: str) -> versions.Version:
    """Append spans, one folder a day; within files by tenant, service and time."""
    return write(stored_rows(spans), path, "spans")


def read_spans(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return read(spark, path, "spans", since, until)


def _cut(as_of: datetime, table: str) -> date:
    """The first day that is kept: one that ended over the table's days ago goes."""
    return as_of.date() - timedelta(days=RETENTION_DAYS[table])


def expired(spark: SparkSession, path: str, as_of: datetime, table: str = "spans") -> DataFrame:
    """What retention deletes: day, folder, files and bytes of every day folder that no longer counts. Nothing is read but names."""
    system, _ = versions._system(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    rows = []
    for root in versions.paths(path, versions.version(spark, path)):
        for x in system.listStatus(hadoop(root)):
            name = x.getPath().getName()
            if x.isDirectory() and name.startswith("_date=") and name[6:] < _cut(as_of, table).isoformat():
                size = system.getContentSummary(x.getPath())
                rows.append((name[6:], x.getPath().toString(), size.getFileCount(), size.getLength()))
    return spark.createDataFrame(rows, "day string, folder string, files bigint, bytes bigint")


def expired_days(spark: SparkSession, path: str, as_of: datetime, table: str = "spans") -> DataFrame:
    """Days that retention no longer keeps whole."""
    return expired(spark, path, as_of, table).select(F.col("day").cast("date").alias("_date")).distinct()


def drop_expired(spark: SparkSession, path: str, as_of: datetime, table: str = "spans", grace_secs: float = 0) -> list[str]:
    """Hide the days that no longer count, then delete their folders; those that went. May be run again at any time.

    With a grace, folders stay until they have been hidden for so long, for readers that began before.
    """
    cut = _cut(as_of, table).isoformat()
    while True:
        former = versions.version(spark, path)
        if former.notes.get("hidden_before", "") >= cut:
            break
        try:
            former = versions.commit(spark, path, former, former.folders, former.notes | {"hidden_before": cut, "hidden_at": time.time()})
            break
        except versions.Conflict:
            continue
    if time.time() - former.notes["hidden_at"] < grace_secs:
        return []
    system, _ = versions._system(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = [r["folder"] for r in expired(spark, path, as_of, table).collect()]
    for folder in gone:
        system.delete(hadoop(folder), True)
    return sorted(gone)
