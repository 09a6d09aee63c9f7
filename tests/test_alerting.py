"""Windows, rules and routes on small written-out cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions import http, spans as fn
from tracewell.operators import alerting, rules, traces
from tracewell.plans.alerts import NAMES
from tracewell.schema import RULE_DDL

OBS = "project_id string, service_id string, sec bigint, duration_us bigint, is_error boolean, arrival_seq bigint"


def obs(spark, rows):
    return spark.createDataFrame([("p", "s", sec, d, e, k) for k, (sec, d, e) in enumerate(rows)], OBS)


def rule(**more):
    base = dict.fromkeys(NAMES) | {"id": "r", "project_id": "p", "name": "n", "service_id": "", "severity": "info", "enabled": True, "cooldown_secs": 30, "metric": "error_rate", "rule_type": "threshold"}
    return base | more


def verdict(spark, rows, **more):
    r = rule(**more)
    table = spark.createDataFrame([tuple(r[n] for n in NAMES)], RULE_DDL)
    (v,) = alerting.evaluate(obs(spark, rows), table, [r]).collect()
    return v


def test_buckets_and_windows(spark):
    (b,) = alerting.buckets(obs(spark, [(7, 500, False), (7, 1000, True), (7, 200, False)])).collect()
    assert (b["count"], b.errors, b.min_us, b.max_us) == (3, 1, 200, 1000)
    w = alerting.newest(alerting.trailing(alerting.buckets(obs(spark, [(0, 1, False), (10, 1, True), (20, 1, False)])), 15)).first()
    assert (w.w_count, w.w_errors) == (2, 1)
    r = alerting.newest(alerting.over_range(alerting.buckets(obs(spark, [(k, 1, False) for k in range(1, 11)])), {"a": (10, 5), "b": (5, 0)})).first()
    assert (r.a_count, r.b_count) == (5, 5)


def test_spread(spark):
    rows = alerting.trailing(alerting.buckets(obs(spark, [(5, x, False) for x in (2, 4, 4, 4, 5, 5, 7, 9)])), 1)
    mean, spread = rows.select(alerting.mean_of("w"), alerting.spread_of("w")).first()
    assert mean == 5 and spread == pytest.approx(2.138, abs=1e-3)


@pytest.mark.parametrize(("errors", "fired"), [(10, True), (2, False)])
def test_threshold(spark, errors, fired):
    v = verdict(spark, [(5, 100, k < errors) for k in range(100)], operator=">", value=0.05, window_secs=60, min_requests=10)
    assert v.fired == fired


def test_threshold_needs_traffic(spark):
    v = verdict(spark, [(5, 100, True)] * 5, operator=">", value=0.05, window_secs=60, min_requests=10)
    assert not v.fired and v.message.startswith("insufficient data: 5 requests < 10")


def test_anomaly_and_rate(spark):
    rows = [(s, 100 + 5 * k, False) for s in range(50) for k in range(10)] + [(s, 1000 + 50 * k, False) for s in range(50, 60) for k in range(10)]
    assert verdict(spark, rows, rule_type="anomaly", metric="p95_latency_us", baseline_window_secs=60, evaluation_window_secs=10, z_score_threshold=3.0).fired
    drop = [(s, 1, False) for s in range(5) for _ in range(100)] + [(s, 1, False) for s in range(5, 10) for _ in range(20)]
    assert verdict(spark, drop, rule_type="rate_of_change", metric="request_count", window_secs=5, change_threshold_pct=-50.0).fired


def test_cooldown_modes(spark):
    fired = spark.createDataFrame([("f", s, True, 30) for s in (0, 10, 20, 30, 40, 50, 60, 200)], "fingerprint string, sec bigint, fired boolean, cooldown_secs int")
    assert sorted(r.sec for r in alerting.emitted(fired).collect()) == [0, 200]
    assert sorted(r.sec for r in alerting.emitted(fired, "fixed").collect()) == [0, 30, 60, 200]


@pytest.mark.parametrize(
    ("path", "route"),
    [("/users/123", "/users/:id"), ("/", "/"), ("", "/"), ("?q=1", "/"), ("/a/550e8400-e29b-41d4-a716-446655440000/b?x#y", "/a/:id/b"), ("/v1/items", "/v1/items"), ("/h/" + "a" * 16, "/h/:id"), ("/h/" + "g" * 31, "/h/" + "g" * 31), ("/h/" + "g" * 32, "/h/:id"), ("/a/1/", "/a/:id/")],
)
def test_routes(spark, path, route):
    assert spark.range(1).select(http.normalize_route(F.lit(path))).first()[0] == route


def test_rule_checks():
    good = {"name": "n", "project_id": "p", "service_id": "", "rule_type": "anomaly", "severity": "info"}
    rules.validate(good)
    for bad in ({"name": ""}, {"name": "é" * 129}, {"project_id": "p" * 129}, {"rule_type": "x"}, {"severity": "x"}):
        with pytest.raises(rules.RuleError):
            rules.validate(good | bad)


def test_config_decode(spark):
    raw = spark.createDataFrame([("a", '{"type":"threshold","metric":"error_rate","operator":">","value":0.5,"window_secs":60}')], "id string, config string")
    r = rules.decode_config(raw).first()
    assert (r.rule_type, r.metric, r.operator, r.value, r.window_secs, r.z_score_threshold) == ("threshold", "error_rate", ">", 0.5, 60, None)


def test_stored_tables(spark, tmp_path):
    from datetime import datetime

    from tracewell.sources import adapters, tables

    found = adapters.root_spans(spark, "/root/testdata/sf0.001")
    tables.write_spans(found.where("start_time < '1995-03-01'"), str(tmp_path / "t"))
    some = tables.read_spans(spark, str(tmp_path / "t"), datetime(1995, 1, 5), datetime(1995, 1, 9))
    assert some.count() == found.where("start_time BETWEEN '1995-01-05' AND '1995-01-09'").count()
    assert "PartitionFilters: [isnotnull(_date" in some._jdf.queryExecution().toString()
    assert tables.expired_days(spark, str(tmp_path / "t"), datetime(1995, 2, 28)).count() > 0


def test_fingerprints_and_ids(spark):
    x = spark.range(1).select(fn.fingerprint(F.lit("r"), F.lit("s"), F.lit("info")), fn.fingerprint(F.lit("r"), F.lit("t"), F.lit("info")), fn.derived_span_id(F.lit("a"))).first()
    assert len(x[0]) == 16 and x[0] != x[1] and x[2] > 0
    assert traces.SUMMARY[0] == "trace_id"


def test_lookups_of_what_is_not_there(spark):
    from tracewell.operators import api

    table = spark.createDataFrame([("rule_1", "n")], "id string, name string")
    assert api.found(rules.get(table, "rule_1"), "rule rule_1").count() == 1
    with pytest.raises(api.NotFoundError):
        api.found(rules.get(table, "rule_2"), "rule rule_2")
    assert api.health(spark).first().status == "ok"


def test_header_value_equals_the_map_of_headers(spark):
    heads = ["Host: a", "HOST:b ", " Host : c", "host:", "no colon", ": d", "X-Host: e", "Host: f:g", "traceparent: t"]
    import itertools

    texts = ["GET / HTTP/1.1\r\n" + "\r\n".join(x) + end for x in itertools.permutations(heads, 2) for end in ("\r\n\r\nHost: late\r\n", "\r\n", "")] + ["GET / HTTP/1.1\r\n\r\nHost: body\r\n", "GET / HTTP/1.1", ""]
    df = spark.createDataFrame([(x.encode(),) for x in texts], "p binary")
    p = F.col("p")
    for name in ("host", "traceparent"):
        bad = df.select(p.cast("string").alias("t"), http.header_value(http.latin(p), name).alias("a"), http.header(http.parse_headers(p), name).alias("b")).where("NOT a <=> b")
        assert bad.collect() == []


def test_alert_ids_order_by_number(spark):
    kind = "id string, project_id string, status string, severity string, fired_at int"
    events = spark.createDataFrame([(f"evt_{k}", "p", "firing", "info", 1) for k in (10, 2, 1)], kind)
    assert [r.id for r in alerting.list_events(events, "p").collect()] == ["evt_1", "evt_2", "evt_10"]


def test_scratch_tables_are_cleared_by_age(spark, tmp_path, monkeypatch):
    from tracewell.sources import scratch

    monkeypatch.setattr(scratch, "root", lambda _: f"file://{tmp_path}/tables")
    assert scratch.clear(spark) == 0
    kept = scratch.written(spark.range(3), "some")
    assert scratch.clear(spark) == 0 and kept.count() == 3
    assert scratch.clear(spark, older_than_hours=-1) == 1


def test_decimals_round_what_a_double_stands_for(spark):
    import random

    rng = random.Random(2)
    values = [0.175, 0.225, 2.095, 0.125, 0.375, 2.5, 3.5, 0.5, -0.175, -0.001, 0.0, 1e14, 123456789.005, 1.005, 2.675, 1e-9, 99.995]
    values += [rng.randrange(10**6) / rng.choice([200, 2000, 7, 8]) for _ in range(2000)] + [rng.uniform(-100, 100) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4):
        got = [r[0] for r in df.select(alerting.fixed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_late_data_is_told_in_chunks_of_arrival(spark):
    """Against a walk over the arrivals; no frame reaches to the end of its group, and none holds a service whole."""
    rng = random.Random(5)
    rows, now = [], 1000
    for k in range(600):
        now += rng.choice([0, 0, 1, 1, 2, 5, 40])
        rows.append((rng.choice(["p", None]), rng.choice("ab"), now - rng.choice([0, 0, 1, 3, 9, 10, 11, 60]), 5, False, k))
    df = spark.createDataFrame(rows, OBS)
    kept, held = [], {}
    for p, s, sec, *_, k in rows:
        w = held.setdefault((p, s), [sec])
        if sec > w[-1]:
            w += [*range(w[-1] + 1, w[-1] + min(sec - w[-1], 10)), sec]
            del w[:-10]
        if sec in w:
            kept.append(k)
    for chunk in (7, 100_000):
        assert sorted(r.arrival_seq for r in alerting.accepted(df, 10, chunk).collect()) == kept
    plan = alerting.accepted(df, 10)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan
    assert all("_part#" in w for w in re.findall(r"windowspecdefinition\(([^)]*)", plan) if "arrival_seq#" in w)
