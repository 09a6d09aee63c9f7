"""The four sinks against what batches give."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_alerting import rule
from tracewell.operators import alerting, rollup
from tracewell.plans.alerts import NAMES
from tracewell.schema import RULE_DDL
from tracewell.sources import adapters, discovery
from tracewell.streaming import queries as streaming

SF = "/root/testdata/sf0.001"


def batches(spark, df, path, order, parts=3):
    """df as a stream of some files in turn, one a batch."""
    pieces = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(order)))
    for k in range(1, parts + 1):
        pieces.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(query):
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None


def test_span_sink(spark, tmp_path):
    spans = adapters.root_spans(spark, SF).where("start_time < '1996-01-01'")
    stream = batches(spark, spans, str(tmp_path / "in"), "span_id")
    drained(streaming.span_sink(stream, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == spans.count() and got.where("_date <> to_date(start_time)").count() == 0


def test_rollup_sink_merges_to_the_batch_result(spark, tmp_path):
    spans = adapters.spans(spark, SF).where("start_time < '1995-06-01'")
    stream = batches(spark, spans, str(tmp_path / "in"), "span_id")
    drained(streaming.rollup_sink(stream, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True))
    keys, counters = ["project_id", "service_id"], ["request_count", "error_count", "total_duration_us", "min_us", "max_us"]
    got = rollup.merged(spark.read.parquet(str(tmp_path / "out")), keys).select(*keys, *counters)
    want = rollup.recounted(rollup.exact(spans), keys).select(*keys, *counters)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_enriched_sink_reads_the_mapping_anew(spark, tmp_path):
    spans = spark.createDataFrame([(k, 1001 + k % 2) for k in range(6)], "seq long, netns long")
    kind = "netns long, project_id string, service_id string, service_name string, environment_id string, container_id string"
    where = str(tmp_path / "services.json")
    checkpoint, out, source = (str(tmp_path / x) for x in ("c", "out", "in"))
    for turn, service in ((0, "svc_old"), (1, "svc_new")):
        discovery.write_mapping(spark.createDataFrame([(1001, "p", service, "s", "e", "c")], kind), where)
        spans.where(F.col("seq").between(3 * turn, 3 * turn + 2)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spans.schema).parquet(source)
        drained(streaming.enriched_sink(stream, where, out, checkpoint, availableNow=True))
    got = {r.seq: (r.service_id, r.container_id) for r in spark.read.parquet(out).collect()}
    assert got == {0: ("svc_old", "c"), 1: ("unknown", "netns-1002"), 2: ("svc_old", "c"), 3: ("unknown", "netns-1002"), 4: ("svc_new", "c"), 5: ("unknown", "netns-1002")}


def test_alert_sink_evaluates_each_batch_with_late_data(spark, tmp_path):
    kind = "project_id string, service_id string, sec bigint, duration_us bigint, is_error boolean, arrival_seq bigint"
    rows = [("p", "s", sec, 1, sec >= 5000, sec) for sec in range(0, 9000, 10)]
    # Late ones of second 8990 stand in the last batch; they take the error rate down again.
    rows += [("p", "s", 8990, 1, False, 9000 + k) for k in range(200)]
    observations = spark.createDataFrame(rows, kind)
    r = rule(operator=">", value=0.5, window_secs=600, min_requests=10, cooldown_secs=100)
    table = spark.createDataFrame([tuple(r[n] for n in NAMES)], RULE_DDL)
    stream = batches(spark, observations, str(tmp_path / "in"), "arrival_seq", parts=4)
    out = str(tmp_path / "out")
    drained(streaming.alert_sink(stream, table, [r], out, str(tmp_path / "c"), availableNow=True))
    fired = sorted((r.batch, r.sec) for r in spark.read.parquet(f"{out}/fired").select("batch", "sec").collect())
    parts = [sorted(x[5] for x in rows)[k * 275 : (k + 1) * 275] for k in range(4)]
    by = {x[5]: x for x in rows}
    want = []
    for k in range(4):
        seen = [by[a] for p in parts[: k + 1] for a in p]
        newest = max(x[2] for x in seen)
        window = [x for x in seen if newest - 600 < x[2] <= newest]
        if len(window) >= 10 and sum(x[4] for x in window) / len(window) > 0.5:
            want.append((k, newest))
    assert fired == want and want
    assert spark.read.parquet(f"{out}/alerts").count() == len(want)


def test_observed_counts_while_writing(spark, tmp_path):
    spans, counters = streaming.observed(adapters.root_spans(spark, SF))
    spans.write.parquet(str(tmp_path / "out"))
    assert counters.get["spans"] == counters.get["roots"] == 1500


def test_window_keeps_late_data_of_seconds_that_have_a_bucket(spark):
    kind = "project_id string, service_id string, sec bigint, duration_us bigint, is_error boolean, arrival_seq bigint"
    rng = random.Random(4)
    seconds = [10, 20, 10, 15, 9, 40, 20, 30, 200, 199, 191, 190, 30, 201, 45, 41]
    for _ in range(400):
        seconds.append(max(0, seconds[-1] + rng.choice([0, 1, 2, 3, 5, 15, -1, -2, -3, -6, -12])))
    df = spark.createDataFrame([("p", "s", x, 1, False, k) for k, x in enumerate(seconds)], kind)
    kept, held = [], []
    for k, x in enumerate(seconds):  # the window as a list of seconds
        if not held or x > held[-1]:
            fill = min(x - held[-1], 10) - 1 if held else 0
            held = (held + [held[-1] + i for i in range(1, fill + 1)] + [x])[-10:] if held else [x]
            kept.append(k)
        elif x in held:
            kept.append(k)
    assert 20 < len(kept) < len(seconds) - 20
    assert sorted(r.arrival_seq for r in alerting.accepted(df, capacity=10).collect()) == kept
