"""Alert windows as state of a stream against the batch form, with late arrivals, gaps and eviction."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_alerting import rule
from tests.test_streams import batches, drained
from tracewell.operators import alerting
from tracewell.plans.alerts import NAMES
from tracewell.schema import RULE_DDL
from tracewell.streaming import alert_windows

KIND = "project_id string, service_id string, sec bigint, duration_us bigint, is_error boolean, arrival_seq bigint"
CAPACITY = 40
RULES = [
    rule(id="r1", operator=">", value=0.4, window_secs=20, min_requests=3, cooldown_secs=10),
    rule(id="r2", rule_type="anomaly", metric="p95_latency_us", baseline_window_secs=35, evaluation_window_secs=10, z_score_threshold=0.3, cooldown_secs=0),
    rule(id="r3", rule_type="rate_of_change", metric="request_count", window_secs=12, change_threshold_pct=30.0, cooldown_secs=5),
    rule(id="r4", operator=">", value=0.0, window_secs=5, min_requests=0, enabled=False),
]


@pytest.fixture(scope="module", autouse=True)
def state_in_rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    alert_windows.rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def observations(seed, n=360):
    """Two services, late ones and gaps up to beyond the capacity; some durations and errors are null."""
    rng = random.Random(seed)
    rows, now = [], {"a": 100, "b": 160}
    for k in range(n):
        s = rng.choice("aab")
        now[s] += rng.choice([0, 0, 1, 1, 2, 5, 25 if rng.random() < 0.2 else 0, 60 if rng.random() < 0.05 else 0])
        late = rng.choice([0, 0, 0, 1, 3, 8, 30, 45])
        rows.append(("p", s, now[s] - late, rng.choice([None, 5, 10, 20, 400, 1000]), rng.choice([True, False, None, (now[s] // 30) % 2 == 0]), k))
    return rows


def rule_table(spark):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in RULES], RULE_DDL)


def test_ring_against_a_list_of_seconds():
    for seed in range(60):
        rng = random.Random(seed)
        capacity = rng.choice([1, 2, 5, 10, 30])
        ring, held, sec = alert_windows.Ring(capacity), [], rng.randint(0, 50)
        for _ in range(300):
            sec = max(0, sec + rng.choice([0, 1, 2, 3, 7, 15, 40, -1, -2, -5, -9, -30]))
            if not held:
                held, taken = [sec], True
            elif sec > held[-1]:
                fill = min(sec - held[-1], capacity) - 1
                held = (held + [held[-1] + i for i in range(1, fill + 1)] + [sec])[-capacity:]
                taken = True
            else:
                taken = sec in held
            assert ring.takes(sec) == taken
            assert [x for a, b in ring.stretches for x in range(a, b + 1)] == held


SHOWN = ["rule_id", "service_id", "sec", "fired", "metric_value", "threshold_value", "message", "fingerprint"]


def expected(spark, rows, parts):
    """Verdicts batch by batch, from the batch operators over all that has come so far."""
    out = []
    size = -(-len(rows) // parts)
    table = rule_table(spark)
    for k in range(parts):
        seen = spark.createDataFrame(rows[: (k + 1) * size], KIND)
        fresh = sorted({r[1] for r in rows[k * size : (k + 1) * size]})
        found = alerting.evaluate(alerting.accepted(seen, CAPACITY), table, RULES).where(F.col("service_id").isin(fresh))
        out.append([tuple(r[c] for c in SHOWN) for r in found.collect()])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_evaluate_over_accepted(spark, tmp_path, seed):
    rows = observations(seed)
    stream = batches(spark, spark.createDataFrame(rows, KIND), str(tmp_path / "in"), "arrival_seq", parts=6)
    found = alert_windows.verdict_stream(stream, RULES, CAPACITY).select(*SHOWN)
    drained(found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    got = [tuple(r[c] for c in SHOWN) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = [x for part in expected(spark, rows, 6) for x in part]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({x[0] for x in want}) == 3 and 5 < sum(x[3] for x in want) < len(want)
    # Some did come too late, and some that were late counted.
    kept = alerting.accepted(spark.createDataFrame(rows, KIND), CAPACITY).count()
    assert kept < len(rows)


def test_no_observation_is_read_twice_after_a_restart(spark, tmp_path):
    rows = observations(5, 240)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for k in range(4):  # a run a part: state comes back from the checkpoint alone
        spark.createDataFrame(rows[60 * k : 60 * (k + 1)], KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        query = alert_windows.verdict_stream(stream, RULES, CAPACITY).select(*SHOWN).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        drained(query)
        assert sum(p["numInputRows"] for p in query.recentProgress) == 60
    got = [tuple(r[c] for c in SHOWN) for r in spark.read.parquet(out).collect()]
    assert sorted(map(repr, got)) == sorted(repr(x) for part in expected(spark, rows, 4) for x in part)


def lives(parts, marks, max_age, mode):
    """Events of fired verdicts (fingerprint, sec, cooldown), part by part: first what a part tells, then the timers up to its watermark."""
    out, state = [], {}
    for fired, mark in zip(parts, marks):
        for name, sec, cooldown in sorted(fired, key=lambda x: x[1]):
            first, last, spoke = state.get(name, (None, None, None))
            if last is not None and sec - last >= max_age:
                out.append((name, "resolved", first, last + max_age))
                last = None
            if last is None:
                first = spoke = sec
                out.append((name, "firing", sec, None))
            elif sec - (last if mode == "sliding" else spoke) >= cooldown:
                spoke = sec
                out.append((name, "firing", sec, None))
            state[name] = first, sec, spoke
        for name, (first, last, _) in list(state.items()):
            if last + max_age <= mark:
                out.append((name, "resolved", first, last + max_age))
                del state[name]
    return sorted(map(repr, out))


@pytest.mark.parametrize("mode,max_age", [("sliding", 30), ("fixed", 45)])
def test_alerts_fire_and_resolve_by_event_time(spark, tmp_path, mode, max_age):
    rows = observations(7, 240)
    rows.append(("p", "z", 100_000, 1, False, 240))  # moves the watermark: all is stale then
    stream = batches(spark, spark.createDataFrame(rows[:240], KIND), str(tmp_path / "in"), "arrival_seq", parts=6)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        events = alert_windows.alert_stream(stream, RULES, max_age, capacity=CAPACITY, mode=mode)
        drained(events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        second = lambda t: None if t is None else int(t)
        found = spark.read.parquet(out).select("fingerprint", "status", F.unix_timestamp("fired_at").alias("f"), F.unix_timestamp("resolved_at").alias("r")).collect()
        return sorted(repr((x.fingerprint, x.status, second(x.f), second(x.r))) for x in found)

    found = expected(spark, rows[:240], 6)
    verdicts = [x for part in found for x in part]
    cooldown = {r["id"]: r["cooldown_secs"] for r in RULES}
    parts = [[(x[7], x[2], cooldown[x[0]]) for x in part if x[3]] for part in found] + [[]]
    newest = max(r[2] for r in rows[:240])
    marks = [0] + [max(r[2] for r in rows[: 40 * k]) for k in range(1, 7)]  # of the batches before, then of a last one without data
    assert run() == lives(parts, marks, max_age, mode)
    # What stale() tells at that watermark is what has been resolved and hasn't fired since.
    columns = "fingerprint string, rule_id string, service_id string, sec bigint, fired boolean"
    table = spark.createDataFrame([(x[7], x[0], x[1], x[2], x[3]) for x in verdicts], columns)
    ends = {}
    for x in spark.read.parquet(out).collect():
        at = x.resolved_at or x.fired_at
        ends[x.fingerprint] = max(ends.get(x.fingerprint, (at, "")), (at, x.status))
    resolved = {f for f, (_, status) in ends.items() if status == "resolved"}
    assert {r.fingerprint for r in alerting.stale(table, newest, max_age).collect()} == resolved
    spark.createDataFrame(rows[240:], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == lives([*parts, [], []], [*marks, newest, 100_000], max_age, mode)
    assert not [r for r in alert_windows.SHOWN if r not in spark.read.parquet(out).columns]
