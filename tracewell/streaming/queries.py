"""Structured Streaming forms: assembly, five-minute roll-ups and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators import alerting, assembly, rollup
from tracewell.sources import discovery, tables


def assembled(events: DataFrame, max_pending: int = 64) -> DataFrame:
    """Spans of a stream of TCP events; state is per 4-tuple."""
    return assembly.assemble_stream(events, max_pending)


def rollup_stream(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counters and sketches per five-minute window, given out when the window has closed."""
    keys = [k for k in rollup.KEYS if k != "window_start"]
    timed = spans.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", delay)
    found = timed.groupBy(*keys, F.window("start_time", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if("is_error").alias("error_count"), F.sum("duration_us").alias("total_duration_us"),
        F.min("duration_us").alias("min_us"), F.max("duration_us").alias("max_us"), F.kll_sketch_agg_bigint("duration_us").alias("sketch"),
    )
    return found.select(*keys, F.col("w.start").alias("window_start"), "request_count", "error_count", "total_duration_us", "min_us", "max_us", "sketch")


def rollup_sink(spans: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch appends its partial rows, as an insert-triggered view does; readers merge them."""

    def append(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch, overwritten if the batch runs again.
        rollup.partial(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return spans.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def span_sink(spans: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append spans by day; a batch is written wholly or not at all."""
    rows = tables.stored_rows(spans)
    return rows.writeStream.format("parquet").partitionBy("_date").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def enriched_sink(spans: DataFrame, mapping_path: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append spans with their services; the mapping's file is read anew for each batch, so that changes count from the next batch on."""
    spark = spans.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        discovery.enriched(batch, discovery.read_mapping(spark, mapping_path)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return spans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


#: Seconds of observations in one folder of the alert sink.
FOLDER_SECS = 3600


def alert_sink(observations: DataFrame, rules: DataFrame, rule_rows: list[dict], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Evaluate the rules after each batch and append what fires.

    A batch's observations are stored first, in folders by time and batch (a repeated batch
    replaces its own); what is read back are the folders of the longest window before the batch's
    newest second, whatever was stored earlier. Late observations count in all windows that still
    hold their second. A firing is emitted by the sliding cooldown against the fired verdicts of
    earlier batches, which are few; those are read as far back as the longest cooldown.
    """
    spark = observations.sparkSession
    reach = max(max(r["window_secs"] or 0, 0) * 2 + (r["baseline_window_secs"] or 0) for r in rule_rows)
    silence = max(r["cooldown_secs"] or 0 for r in rule_rows)
    folder = lambda sec: F.floor(sec / FOLDER_SECS).cast("bigint")

    def stored(df: DataFrame, name: str, batch_id: int) -> None:
        rows = df.withColumns({"folder": folder(F.col("sec")), "batch": F.lit(batch_id).cast("bigint")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "batch").parquet(f"{path}/{name}")

    def since(name: str, schema, sec: int, batch_id: int) -> DataFrame:
        kind = T.StructType([*schema.fields, T.StructField("folder", T.LongType()), T.StructField("batch", T.LongType())])
        df = spark.read.schema(kind).parquet(f"{path}/{name}")
        return df.where((F.col("folder") >= sec // FOLDER_SECS) & (F.col("sec") > sec) & (F.col("batch") <= batch_id))

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("sec")).first()[0]
        if newest is None:
            return
        stored(batch, "observations", batch_id)
        seen = since("observations", batch.schema, newest - reach - 1, batch_id).drop("folder", "batch")
        verdicts = alerting.evaluate(seen, rules, rule_rows).where("fired")
        stored(verdicts, "fired", batch_id)
        fired = since("fired", verdicts.schema, newest - reach - silence - 1, batch_id).drop("folder")
        alerting.emitted(fired).where(F.col("batch") == batch_id).drop("batch").write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    return observations.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def observed(spans: DataFrame, name: str = "spans") -> tuple[DataFrame, Observation]:
    """spans with counters that fill as they are written, without another pass: spans, errors, roots."""
    counters = Observation(name)
    return spans.observe(counters, F.count(F.lit(1)).alias("spans"), F.count_if("is_error").alias("errors"), F.count_if("is_root").alias("roots")), counters
