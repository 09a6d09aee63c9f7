"""Versioned tables, stores, roll-ups with compaction, retention and choice of files."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_alerting import rule
from tests.test_streams import batches, drained
from tracewell.operators import rollup, rules as rule_ops, topology
from tracewell.plans.alerts import NAMES
from tracewell.schema import ALERT_DDL, RULE_DDL
from tracewell.sources import adapters, discovery, rollups, stores, tables, versions

SF = "/root/testdata/sf0.001"
KIND = "k long, v long"


def numbered(spark, v, n=50):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(v).cast("long").alias("v"))


def test_a_reader_in_a_loop_sees_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, KIND).count() == 0
    versions.replace(numbered(spark, 0), path)
    seen, errors, done = [], [], threading.Event()

    def loop():
        while not done.is_set():
            try:
                seen.append({(r.v, r.n) for r in versions.read(spark, path, KIND).groupBy("v").agg(F.count("*").alias("n")).collect()})
            except Exception as error:  # noqa: BLE001
                errors.append(error)
                return

    reader = threading.Thread(target=loop)
    reader.start()
    for v in range(1, 9):
        versions.replace(numbered(spark, v), path)
        versions.vacuum(spark, path, keep=4, older_than_secs=3600)
    done.set()
    reader.join(60)
    assert not errors and len(seen) > 3
    assert all(len(x) == 1 and next(iter(x))[1] == 50 for x in seen)
    shown = [next(iter(x))[0] for x in seen]
    assert shown == sorted(shown)
    gone = versions.vacuum(spark, path, keep=2, older_than_secs=0)
    assert len(gone) == 7 and versions.numbers(spark, path) == [8, 9]
    assert versions.read(spark, path, KIND, 8).first().v == 7 and versions.read(spark, path, KIND).first().v == 8


def test_of_two_writers_from_one_version_the_second_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    first = versions.replace(numbered(spark, 1), path)
    versions.replace(numbered(spark, 2), path, first)
    with pytest.raises(versions.Conflict):
        versions.replace(numbered(spark, 3), path, first)
    assert versions.read(spark, path, KIND).first().v == 2
    results = []

    def race(k):
        try:
            results.append(versions.commit(spark, path, versions.Version(2), [f"x{k}"]).number)
        except versions.Conflict:
            results.append(None)

    racers = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    for x in racers:
        x.start()
    for x in racers:
        x.join()
    assert sorted(results, key=str) == [3] + [None] * 7
    bump = lambda rows: rows.withColumn("v", F.col("v") + 1)
    other = str(tmp_path / "u")
    versions.replace(numbered(spark, 0, 3), other)
    racers = [threading.Thread(target=versions.changed, args=(spark, other, KIND, bump, 50)) for _ in range(4)]
    for x in racers:
        x.start()
    for x in racers:
        x.join()
    assert versions.read(spark, other, KIND).first().v == 4  # no change was lost


def test_mapping_versions(spark, tmp_path):
    kind = "netns long, project_id string, service_id string, service_name string, environment_id string, container_id string"
    one = spark.createDataFrame([(1, "p", "s", "n", "e", "c"), (2, "p", "t", "n", "e", None)], kind)
    first = discovery.write_mapping(one, str(tmp_path / "m"))
    discovery.write_mapping(one.where("netns = 1"), str(tmp_path / "m"), first)
    with pytest.raises(versions.Conflict):
        discovery.write_mapping(one, str(tmp_path / "m"), first)
    assert [r.netns for r in discovery.read_mapping(spark, str(tmp_path / "m")).collect()] == [1]
    (tmp_path / "services.json").write_text('{"7":{"project_id":"p","service_id":"s"},"8":{"service_id":"t"}}')
    assert sorted(r.netns for r in discovery.read_mapping(spark, str(tmp_path / "services.json")).collect()) == [7, 8]


def test_rules_and_events_last(spark, tmp_path):
    store = stores.AlertStore(spark, str(tmp_path))
    fresh = spark.createDataFrame([tuple(rule(name=n, project_id="p", value=1.0)[c] for c in NAMES) for n in ("b", "a")], RULE_DDL)
    store.create(fresh)
    store.create(fresh.where("name = 'a'").drop("id", "enabled", "z_score_threshold"))
    assert sorted((r.id, r.name, r.enabled) for r in store.rules().collect()) == [("rule_1", "a", True), ("rule_2", "b", True), ("rule_3", "a", True)]
    with pytest.raises(rule_ops.RuleError):
        store.create(fresh.withColumn("severity", F.lit("loud")))
    events = spark.createDataFrame([(f"evt_{k}", f"rule_{1 + k % 3}", "n", "p", "s", "info", "firing", "m", 1.0, 1.0, datetime(2024, 1, 1, 0, k), None) for k in range(6)], ALERT_DDL)
    store.add_events(events.where("id < 'evt_3'"))
    store.add_events(events.where("id >= 'evt_3'"))
    store.update(store.rules().where("id = 'rule_2'").withColumn("severity", F.lit("critical")))
    store.update(fresh.withColumn("id", F.lit("rule_99")))  # there is no such rule
    store.delete(spark.createDataFrame([("rule_1",)], "id string"))
    again = stores.AlertStore(spark, str(tmp_path))
    assert sorted((r.id, r.severity) for r in again.rules().collect()) == [("rule_2", "critical"), ("rule_3", "info")]
    assert [r.id for r in again.list_events("p").collect()] == ["evt_1", "evt_2", "evt_4", "evt_5"]
    assert versions.read(spark, again.events_path, ALERT_DDL).count() == 4


COUNTERS = ["request_count", "error_count", "total_duration_us", "min_us", "max_us"]


def totals(rows):
    return sorted(map(tuple, rollup.recounted(rows, ["project_id", "service_id"]).collect()))


def test_rollup_folders_are_dealt_by_key_and_not_by_tenant(spark, tmp_path, monkeypatch):
    """One tenant has all rows: the parts of a compaction follow the rows, and more than one task holds some."""
    monkeypatch.setattr(rollups, "PART_ROWS", 100)
    path = str(tmp_path / "r")
    found = adapters.root_spans(spark, SF).where("project_id = 'proj_demo'").limit(1000).cache()
    for k in range(2):
        rollups.append(found.where(F.col("span_id") % 2000 < 1000 if k else F.col("span_id") % 2000 >= 1000), path, "s", k)
    want, n = totals(rollup.exact(found)), rollups.read(spark, path).count()
    made = rollups.compact(spark, path, fan_in=2)
    (folder,) = made.folders
    assert len(list((tmp_path / "r" / folder).glob("*.parquet"))) > min(4, n // 200)
    assert totals(rollups.read(spark, path)) == want


def test_rollups_before_during_and_after_compaction(spark, tmp_path):
    path = str(tmp_path / "r")
    found = adapters.spans(spark, SF).where("start_time < '1996-06-01'").withColumn("_b", F.pmod("span_id", F.lit(9))).cache()
    want = totals(rollup.exact(found))
    for k in range(9):
        rollups.append(found.where(F.col("_b") == k), path, "s", k)
    rollups.append(found.where("_b = 3"), path, "s", 3)  # run again: no effect
    before = versions.version(spark, path)
    assert len(before.folders) == 9 and totals(rollups.read(spark, path)) == want
    held = rollups.read(spark, path)  # a reader that has begun
    after = rollups.compact(spark, path, fan_in=3)
    assert len(after.folders) == 1 and {x["level"] for x in after.notes["folders"].values()} == {1}
    assert totals(held) == want and totals(rollups.read(spark, path, number=before.number)) == want
    assert totals(rollups.read(spark, path)) == want
    for n in versions.numbers(spark, path)[8:]:  # no version in between is mixed
        assert totals(rollups.read(spark, path, number=n)) == want
    assert rollups.read(spark, path).groupBy(*rollup.KEYS).count().where("count > 1").count() == 0
    # Quantiles of merged sketches stay near.
    got = rollup.merged(rollups.read(spark, path), ["project_id"]).select("project_id", "p50_us").collect()
    exact = dict(map(tuple, rollup.exact(found, ["project_id"]).select("project_id", "p50_us").collect()))
    assert all(abs(r.p50_us - exact[r.project_id]) < 0.1 * exact[r.project_id] for r in got)
    since, until = datetime(1995, 5, 1), datetime(1995, 6, 1)
    part = found.where((F.col("start_time") >= since) & (F.col("start_time") < until))
    rollups.append(part, path, "other", 0)
    assert totals(rollups.read(spark, path, since).where(F.col("window_start") < until)) == totals(rollup.exact(part.unionAll(part)))
    opened = rollups.read(spark, path, datetime(1996, 1, 1)).inputFiles()
    assert opened and not any(f.split("/")[-2] not in after.folders for f in opened)  # the folder of May 1995 stays shut


def test_rollup_sink_adds_each_batch_once(spark, tmp_path):
    found = adapters.spans(spark, SF).where("start_time < '1995-06-01'")
    stream = batches(spark, found, str(tmp_path / "in"), "span_id", parts=4)
    drained(rollups.sink(stream, str(tmp_path / "r"), str(tmp_path / "c"), fan_in=2, availableNow=True))
    assert totals(rollups.read(spark, str(tmp_path / "r"))) == totals(rollup.exact(found))
    assert len(versions.version(spark, str(tmp_path / "r")).folders) == 1
    drained(rollups.sink(stream, str(tmp_path / "r"), str(tmp_path / "c2"), fan_in=2, availableNow=True))  # all batches again, from no checkpoint
    assert totals(rollups.read(spark, str(tmp_path / "r"))) == totals(rollup.exact(found))


def test_retention_drops_day_folders_of_all_tables(spark, tmp_path):
    found = adapters.spans(spark, SF).where("start_time BETWEEN '1997-01-01' AND '1997-05-20'").cache()
    logs = adapters.trace_logs(spark, SF)
    last = logs.agg(F.max("timestamp")).first()[0]
    made = {
        "spans": (tables.stored_rows(found), datetime(1997, 5, 20, 13)),
        "trace_logs": (logs, last),
        "rollup": (rollup.partial(found), datetime(1997, 5, 20, 13)),
        "dependencies": (topology.edges(found), datetime(1997, 5, 20, 13)),
    }
    for name, days in (("spans", 7), ("trace_logs", 7), ("rollup", 90), ("dependencies", 30)):
        rows, as_of = made[name]
        path, time = str(tmp_path / name), tables.LAYOUTS[name].time
        tables.write(rows, path, name, shards=2)
        cut = f"date_sub(DATE '{as_of.date()}', {days})"
        old, kept = rows.where(f"to_date({time}) < {cut}").count(), rows.where(f"to_date({time}) >= {cut}").count()
        plan = tables.expired(spark, path, as_of, name).collect()
        assert len(plan) == rows.where(f"to_date({time}) < {cut}").select(F.to_date(time)).distinct().count()
        assert sum(r.files for r in plan) >= len(plan) and all(r.bytes > 0 for r in plan)
        begun = tables.read(spark, path, name)
        assert tables.drop_expired(spark, path, as_of, name, grace_secs=600) == [] and begun.count() == old + kept
        begun = begun.where(f"_date >= {cut}")
        gone = tables.drop_expired(spark, path, as_of, name)
        assert len(gone) == len(plan) and tables.read(spark, path, name).count() == kept == begun.count()
        assert tables.drop_expired(spark, path, as_of, name) == [] and tables.expired(spark, path, as_of, name).count() == 0
        assert old > 0 or name == "trace_logs"
        # A run that stopped after hiding: nothing old is shown, and the next run deletes it.
        tables.write(rows, path, name, shards=2)
        assert tables.read(spark, path, name).count() == 2 * kept
        assert len(tables.drop_expired(spark, path, as_of, name)) == len(plan)


def test_lookups_open_few_files(spark, tmp_path):
    found = tables.stored_rows(adapters.spans(spark, SF).where("start_time BETWEEN '1997-01-01' AND '1997-02-15'")).cache()
    path = str(tmp_path / "spans")
    tables.write(found.where("span_id % 2 = 0"), path, "spans")
    tables.write(found.where("span_id % 2 = 1"), path, "spans")
    every = len(tables.read(spark, path, "spans").inputFiles())
    columns = sorted(found.columns)
    shown = lambda df: sorted(map(str, df.select(columns).collect()))
    ids = [r.trace_id for r in found.select("trace_id").distinct().orderBy("trace_id").limit(6).collect()]
    for trace in ids:
        got = tables.lookup(spark, path, "spans", {"trace_id": trace, "project_id": "proj_demo"})
        assert shown(got) == shown(found.where((F.col("trace_id") == trace) & (F.col("project_id") == "proj_demo")))
        assert tables.files(spark, path, "spans", {"trace_id": trace}).count() < 0.05 * every
        assert len(got.inputFiles()) < 0.05 * every or got.isEmpty()
    assert tables.lookup(spark, path, "spans", {"trace_id": "0" * 32}).count() == 0
    since, until = datetime(1997, 1, 10, 3), datetime(1997, 1, 12, 9)
    got = tables.lookup(spark, path, "spans", {"service_id": "svc_s3"}, since, until)
    assert shown(got) == shown(found.where((F.col("service_id") == "svc_s3") & F.col("start_time").between(since, until)))
    logs = adapters.trace_logs(spark, SF)
    tables.write(logs, str(tmp_path / "logs"), "trace_logs")
    one = logs.orderBy("span_id").first().trace_id
    assert tables.lookup(spark, str(tmp_path / "logs"), "trace_logs", {"trace_id": one}).count() == logs.where(F.col("trace_id") == one).count() > 0
