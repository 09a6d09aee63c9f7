"""Queries over alert windows, rules and events. Buckets are hours here, as events are sparse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.spans import lookback_secs
from tracewell.operators import alerting, api, rules as rule_ops
from tracewell.schema import RULE_DDL
from tracewell.sources import adapters, scratch
from tracewell.streaming import alert_windows

W = 24
SUMS = ("s_n", "s_sum", "s_squares")

RULES = [
    ("r1", "proj_demo", "errors", "", "threshold", "error_rate", ">", 0.1, W, 10, None, None, None, None, "critical", True, 48),
    ("r2", "proj_demo", "slow", "svc_1", "threshold", "p95_latency_us", ">=", 40000.0, W, 5, None, None, None, None, "warning", True, 12),
    ("r3", "proj_demo", "odd errors", "", "anomaly", "error_rate", None, None, None, None, 168, W, 1.5, None, "warning", True, 24),
    ("r4", "proj_demo", "more traffic", "svc_2", "rate_of_change", "request_count", None, None, W, None, None, None, None, 20.0, "info", True, 24),
    ("r5", "proj_demo", "off", "", "threshold", "request_count", ">", 0.0, W, 0, None, None, None, None, "info", False, 24),
    ("r6", "proj_else", "elsewhere", "", "threshold", "request_count", ">", 0.0, W, 0, None, None, None, None, "info", True, 24),
    ("r7", "proj_demo", "less traffic", "", "rate_of_change", "request_count", None, None, W, None, None, None, None, -20.0, "info", True, 24),
    ("r8", "proj_demo", "odd latency", "", "anomaly", "p50_latency_us", None, None, None, None, 168, W, 0.05, None, "warning", True, 24),
]
NAMES = [x.split()[0] for x in RULE_DDL.split(", ")]


def rule_table(spark):
    return spark.createDataFrame(RULES, RULE_DDL)


def rule_rows(*ids):
    return [dict(zip(NAMES, r)) for r in RULES if not ids or r[0] in ids]


def verdicts(spark, sf_dir, *ids, every_second=True):
    return alerting.evaluate(adapters.observations(spark, sf_dir), rule_table(spark), rule_rows(*ids), every_second=every_second)


SHOWN = ["rule_id", "project_id", "service_id", "severity", "sec", "fired", "metric_value", "threshold_value", "fingerprint"]


def _shown(df):
    return df.select(*[F.round(c, 6).alias(c) if c.endswith("_value") else F.col(c) for c in SHOWN])


def _joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def bucket_1s(spark, sf_dir):
    return alerting.buckets(adapters.observations(spark, sf_dir)).withColumn("samples", _joined("samples")).drop(*SUMS)


def bucket_first_samples(spark, sf_dir):
    return alerting.buckets(adapters.observations(spark, sf_dir), samples=3).withColumn("samples", _joined("samples")).drop(*SUMS)


def trailing_window(spark, sf_dir):
    rows = alerting.trailing(alerting.buckets(adapters.observations(spark, sf_dir), gather=False), W)
    return rows.select("service_id", "sec", "w_count", "w_errors", "w_sum_us", "w_min_us", "w_max_us")


def range_window(spark, sf_dir):
    rows = alerting.over_range(alerting.buckets(adapters.observations(spark, sf_dir), gather=False), {"w": (2 * W, W)})
    return rows.select("service_id", "sec", "w_count", "w_errors", "w_sum_us")


def nearest_rank_percentile(spark, sf_dir):
    rows = alerting.trailing(alerting.buckets(adapters.observations(spark, sf_dir)), W)
    return rows.select("service_id", "sec", *[F.col(f"w_p{p}_latency_us").alias(f"p{p}") for p in (50, 95, 99)])


def zscore_baseline(spark, sf_dir):
    rows = alerting.over_range(alerting.buckets(adapters.observations(spark, sf_dir)), {"b": (168, W)}, latencies=False)
    return rows.select("service_id", "sec", F.col("b_s_n").cast("int").alias("n"), F.round(alerting.mean_of("b"), 3).alias("mean"), F.round(alerting.spread_of("b"), 3).alias("stddev"))


def rate_of_change(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir, "r7"))


def threshold_rule(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir, "r1"))


def threshold_newest(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir, "r1", "r2", every_second=False))


def anomaly_rule(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir, "r3"))


def anomaly_latency_rule(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir, "r8"))


def rate_rule(spark, sf_dir):
    return _shown(verdicts(spark, sf_dir, "r4"))


def rule_service_scope(spark, sf_dir):
    services = adapters.observations(spark, sf_dir).select("project_id", "service_id").distinct()
    return alerting.for_services(rule_table(spark), services).select("id", "name", "watched_service")


def cooldown_emit(spark, sf_dir):
    return alerting.emitted(verdicts(spark, sf_dir, "r1")).select("rule_id", "service_id", "sec", "fingerprint")


def cooldown_fixed(spark, sf_dir):
    return alerting.emitted(verdicts(spark, sf_dir, "r1"), mode="fixed").select("rule_id", "service_id", "sec", "fingerprint")


def stale_resolve(spark, sf_dir):
    return alerting.stale(verdicts(spark, sf_dir, "r1"), as_of_sec=474500, max_age=429)


def alert_event_filter(spark, sf_dir):
    events = alerting.alert_events(alerting.emitted(verdicts(spark, sf_dir, "r1", "r7")))
    return alerting.list_events(events, "proj_demo", status="firing", severity="info", limit=20).select("id", "rule_id", "service_id", "severity", "status", "fired_at")


def alert_messages(spark, sf_dir):
    """Messages of threshold and change verdicts: of too little data, firing and quiet."""
    return verdicts(spark, sf_dir, "r1", "r7").select("rule_id", "service_id", "sec", "message")


def every_nth_span(spark, sf_dir):
    return alerting.every_nth(adapters.observations(spark, sf_dir), n=50, chunk=1000).select("arrival_seq", "service_id", "sec")


def late_data(spark, sf_dir):
    """What windows of 24 buckets take of observations of which some come late."""
    o = adapters.observations(spark, sf_dir)
    k = F.col("arrival_seq")
    return alerting.accepted(o.withColumn("sec", F.col("sec") - F.when(k % 7 == 0, k % 60).otherwise(0)), capacity=W).select("service_id", "sec", "arrival_seq")


PARTS = 8
MAX_AGE = 150


def _streamed(spark, sf_dir, found):
    """What found makes of a stream of the observations, PARTS batches of arrival order; run to the end, state in RocksDB."""
    root = scratch.path(spark, "stream")
    o = adapters.observations(spark, sf_dir)
    last = o.agg(F.max("arrival_seq")).first()[0] or 0
    part = F.floor(F.col("arrival_seq") * PARTS / (last + 1))
    for k in range(PARTS):  # one after another, so that a stream of files takes them in order
        o.where(part == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    alert_windows.rocksdb(spark)
    try:
        found(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{root}/out")


def stream_verdicts(spark, sf_dir):
    """Verdicts at each service's newest second after every batch, from windows kept as state."""
    return _shown(_streamed(spark, sf_dir, lambda o: alert_windows.verdict_stream(o, rule_rows("r1", "r7"))))


def stream_alert_events(spark, sf_dir):
    """Alerts of a stream as they fire and resolve."""
    found = _streamed(spark, sf_dir, lambda o: alert_windows.alert_stream(o, rule_rows("r1", "r7"), MAX_AGE))
    return found.select("fingerprint", "rule_id", "service_id", "status", F.unix_timestamp("fired_at").alias("fired_sec"), F.unix_timestamp("resolved_at").cast("string").alias("resolved_sec"))


def health(spark, sf_dir):
    return api.health(spark, events=adapters.table(spark, sf_dir, "events"), orders=adapters.table(spark, sf_dir, "orders"))


FRESH = "name string, project_id string, service_id string, rule_type string, severity string, cooldown_secs bigint"


def rule_create(spark, sf_dir):
    """Rules of some customers and new ones, of which those without violations are stored."""
    rules = _candidates(spark, sf_dir).where("severity = 'info'").withColumns({"enabled": F.lit(False), "cooldown_secs": F.lit(7).cast("bigint")})
    fresh = _candidates(spark, sf_dir).select(F.concat(F.lit("new "), F.col("id"), F.lit(" "), F.col("name")).alias("name"), "project_id", "service_id", "rule_type", "severity", F.when(F.length("id") % 2 == 0, F.lit(60)).cast("bigint").alias("cooldown_secs"))
    good = rule_ops.violations(fresh).where("problem IS NULL").drop("problem")
    return rule_ops.create(rules, good).select("id", "name", "enabled", "cooldown_secs")


def rule_get(spark, sf_dir):
    return rule_ops.get(_candidates(spark, sf_dir), "rule_42").select("id", "name", "severity")


def rules_of_project(spark, sf_dir):
    return rule_ops.of_project(_candidates(spark, sf_dir), "BUILDING").select("id", "name", "severity")


def rule_duplicates(spark, sf_dir):
    """(project, name) pairs that the unique constraint forbids."""
    return rule_ops.duplicates(_candidates(spark, sf_dir))


def rule_lookback(spark, sf_dir):
    """Seconds of history that rules of all types, made from customers, read."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in rule_ops.TYPES]), (k % 3 + 1).cast("int"))
    return adapters.table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("rule_type"), (k % 600).alias("window_secs"), (k % 7000).alias("baseline_window_secs")).select("id", lookback_secs().alias("lookback"))


def anomaly_messages(spark, sf_dir):
    """Messages of the anomaly rule: of too little data, of no variance, and with the score."""
    return verdicts(spark, sf_dir, "r3").select("rule_id", "service_id", "sec", "message")


def _candidates(spark, sf_dir):
    c = adapters.table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 6
    return c.select(
        F.concat(F.lit("rule_"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(k == 0, "").when(k == 1, F.repeat(F.lit("é"), 129)).otherwise(F.col("c_name")).alias("name"),
        F.when(k == 2, F.repeat(F.lit("p"), 129)).otherwise(F.col("c_mktsegment")).alias("project_id"),
        F.lit("").alias("service_id"),
        F.when(k == 3, "sometimes").otherwise("anomaly").alias("rule_type"),
        F.when(k == 4, "loud").otherwise("info").alias("severity"),
    )


def rule_validation(spark, sf_dir):
    return rule_ops.violations(_candidates(spark, sf_dir)).select("id", "problem")


def rule_delete_cascade(spark, sf_dir):
    rules = _candidates(spark, sf_dir)
    gone = rules.where("severity = 'loud'").select("id")
    orders = adapters.table(spark, sf_dir, "orders")
    events = orders.select(F.concat(F.lit("rule_"), F.col("o_custkey").cast("string")).alias("rule_id"), F.col("o_orderkey").alias("event"))
    return rule_ops.cascade(events, rule_ops.delete(rules, gone))


def rule_update(spark, sf_dir):
    rules = _candidates(spark, sf_dir).withColumn("enabled", F.lit(False))
    changed = rules.where("severity = 'loud'").withColumn("severity", F.lit("critical"))
    return rule_ops.update(rules, changed).select("id", "severity", "enabled")


OBS = """
WITH obs AS (
    SELECT 'proj_demo' AS project_id, 'svc_' || (user_id % 4) AS service_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS sec,
        CAST(floor(value * 1000) AS BIGINT) AS duration_us, event_type = 'error' AS is_error, event_id AS arrival_seq FROM events
), buckets AS (
    SELECT project_id, service_id, sec, count(*) AS count, count(*) FILTER (WHERE is_error) AS errors, CAST(sum(duration_us) AS BIGINT) AS sum_us,
        min(duration_us) AS min_us, max(duration_us) AS max_us, list_sort(list(duration_us) FILTER (WHERE n <= {cap})) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY service_id, sec ORDER BY arrival_seq) AS n FROM obs) GROUP BY ALL
)
"""


def _frame(name, a, b):
    """A table of aggregates over (sec - a, sec - b] at every bucket."""
    return f"""{name} AS (
    SELECT x.service_id, x.sec, CAST(coalesce(sum(y.count), 0) AS BIGINT) AS count, CAST(coalesce(sum(y.errors), 0) AS BIGINT) AS errors,
        CAST(coalesce(sum(y.sum_us), 0) AS BIGINT) AS sum_us, min(y.min_us) AS min_us, max(y.max_us) AS max_us,
        coalesce(list_sort(flatten(list(y.samples) FILTER (WHERE y.samples IS NOT NULL))), []) AS samples
    FROM buckets x LEFT JOIN buckets y ON x.service_id = y.service_id AND y.sec BETWEEN x.sec - {a - 1} AND x.sec - {b} GROUP BY x.service_id, x.sec)"""


def _rank(p, samples="samples"):
    return f"CASE WHEN len({samples}) > 0 THEN CAST({samples}[greatest(1, least(len({samples}), CAST(ceil(len({samples}) * CAST({p} AS DOUBLE)) AS INTEGER)))] AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def _finger(rule, severity):
    return f"substr(md5('{rule}|' || service_id || '|{severity}'), 1, 16)"


def _threshold(rule, severity, metric, op, limit, least, where="true"):
    value = f"CASE WHEN count >= {least} THEN {metric} ELSE CAST(0 AS DOUBLE) END"
    return f"""SELECT '{rule}' AS rule_id, 'proj_demo' AS project_id, service_id, '{severity}' AS severity, sec, count >= {least} AND {value} {op} {limit} AS fired,
        round({value}, 6) AS metric_value, CAST({limit} AS DOUBLE) AS threshold_value, {_finger(rule, severity)} AS fingerprint FROM w WHERE {where}"""


RATE = "CASE WHEN count > 0 THEN errors / count ELSE CAST(0 AS DOUBLE) END"
BASE = OBS.format(cap=100)
R1 = _threshold("r1", "critical", RATE, ">", 0.1, 10)


def _change(rule, severity, limit, op, where="true"):
    return f"""{BASE}, {_frame("b", 2 * W, W)}, {_frame("c", W, 0)}, j AS (SELECT service_id, sec, b.count AS before, c.count AS now FROM b JOIN c USING (service_id, sec))
        SELECT '{rule}' AS rule_id, 'proj_demo' AS project_id, service_id, '{severity}' AS severity, sec,
            before > 0 AND (CASE WHEN before = 0 THEN 0 ELSE (now - before) / before * 100 END) {op} {limit} AS fired, CAST(now AS DOUBLE) AS metric_value,
            CASE WHEN before > 0 THEN CAST(before AS DOUBLE) ELSE CAST({limit} AS DOUBLE) END AS threshold_value, {_finger(rule, severity)} AS fingerprint FROM j WHERE {where}"""


def _anomaly(rule, value_b, value_c, spread, z):
    return f"""{BASE}, {_frame("b", 168, W)}, {_frame("c", W, 0)}, j AS (SELECT b.service_id, b.sec, len(b.samples) AS n, {value_b} AS base, {value_c} AS cur, {spread} AS sd
            FROM b JOIN c ON b.service_id = c.service_id AND b.sec = c.sec)
        SELECT '{rule}' AS rule_id, 'proj_demo' AS project_id, service_id, 'warning' AS severity, sec,
            n >= 10 AND sd >= 1e-10 AND coalesce(abs(cur - base) / nullif(sd, 0) > {z}, false) AS fired, round(CASE WHEN n >= 10 THEN cur ELSE CAST(0 AS DOUBLE) END, 6) AS metric_value,
            round(CASE WHEN n >= 10 AND sd >= 1e-10 THEN base ELSE CAST({z} AS DOUBLE) END, 6) AS threshold_value, {_finger(rule, 'warning')} AS fingerprint FROM j"""


CANDIDATES = """WITH c AS (SELECT 'rule_' || c_custkey AS id, c_custkey % 6 AS k, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('é', 129) ELSE c_name END AS name FROM customer)"""
SAMPLES_OUT = "SELECT project_id, service_id, sec, count, errors, sum_us, min_us, max_us, array_to_string(samples, ',') AS samples FROM buckets"
FIRED = f"{BASE}, {_frame('w', W, 0)}, v AS ({R1}), f AS (SELECT * FROM v WHERE fired)"

CHANGED = f"""{_frame('b', 2 * W, W)}, {_frame('c', W, 0)}, j AS (SELECT service_id, sec, b.count AS before, c.count AS now FROM b JOIN c USING (service_id, sec)),
    ch AS (SELECT *, before > 0 AND (CASE WHEN before = 0 THEN 0 ELSE (now - before) / before * 100 END) <= -20.0 AS fired FROM j)"""
SPOKE = f"""{FIRED.replace("WITH obs", "WITH RECURSIVE obs", 1)}, spoke AS (SELECT fingerprint, min(sec) AS sec FROM f GROUP BY fingerprint UNION ALL
    SELECT s.fingerprint, min(f.sec) FROM spoke s JOIN f ON f.fingerprint = s.fingerprint AND f.sec >= s.sec + 48 GROUP BY s.fingerprint)"""
NAMED = f"""{CANDIDATES}, r AS (SELECT c.id, c.k, c.name, CASE WHEN c.k = 2 THEN repeat('p', 129) ELSE c_mktsegment END AS project_id, CASE WHEN c.k = 4 THEN 'loud' ELSE 'info' END AS severity FROM c JOIN customer ON c.id = 'rule_' || c_custkey)"""

STREAMED = f"""WITH o AS (SELECT 'svc_' || (user_id % 4) AS service_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS sec, event_type = 'error' AS e, event_id * {PARTS} // (max(event_id) OVER () + 1) AS part FROM events),
    n AS (SELECT part, service_id, max(sec) AS sec FROM o GROUP BY ALL),
    x AS (SELECT n.part, n.service_id, n.sec, count(*) FILTER (o.sec > n.sec - {W}) AS count, count(*) FILTER (o.sec > n.sec - {W} AND e) AS errors, count(*) FILTER (o.sec <= n.sec - {W}) AS before
        FROM n JOIN o ON o.service_id = n.service_id AND o.part <= n.part AND o.sec > n.sec - {2 * W} GROUP BY ALL),
    v AS (SELECT 'r1' AS rule_id, 'proj_demo' AS project_id, service_id, 'critical' AS severity, sec, count >= 10 AND errors / count > 0.1 AS fired, round(CASE WHEN count >= 10 THEN errors / count ELSE CAST(0 AS DOUBLE) END, 6) AS metric_value,
            CAST(0.1 AS DOUBLE) AS threshold_value, {_finger('r1', 'critical')} AS fingerprint, 48 AS cooldown FROM x
        UNION ALL SELECT 'r7', 'proj_demo', service_id, 'info', sec, before > 0 AND (count - before) / nullif(before, 0) * 100 <= -20, CAST(count AS DOUBLE), CASE WHEN before > 0 THEN CAST(before AS DOUBLE) ELSE CAST(-20 AS DOUBLE) END, {_finger('r7', 'info')}, 24 FROM x)"""

SQL = {
    "stream_verdicts": f"{STREAMED} SELECT * EXCLUDE (cooldown) FROM v",
    "stream_alert_events": f"""{STREAMED}, f AS (SELECT *, sec - lag(sec) OVER own AS gap, lead(sec) OVER own - sec AS next FROM v WHERE fired WINDOW own AS (PARTITION BY fingerprint ORDER BY sec)),
        g AS (SELECT *, last_value(CASE WHEN gap IS NULL OR gap >= {MAX_AGE} THEN sec END IGNORE NULLS) OVER (PARTITION BY fingerprint ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first FROM f)
        SELECT fingerprint, rule_id, service_id, 'firing' AS status, sec AS fired_sec, CAST(NULL AS VARCHAR) AS resolved_sec FROM g WHERE gap IS NULL OR gap >= least(cooldown, {MAX_AGE})
        UNION ALL SELECT fingerprint, rule_id, service_id, 'resolved', first, CAST(sec + {MAX_AGE} AS VARCHAR) FROM g WHERE next >= {MAX_AGE} OR (next IS NULL AND (SELECT max(sec) FROM o) - sec >= {MAX_AGE})""",
    "alert_messages": f"""{BASE}, {_frame('w', W, 0)}, {CHANGED}
        SELECT 'r1' AS rule_id, service_id, sec, CASE WHEN count < 10 THEN printf('insufficient data: %d requests < 10 min_requests', count)
            WHEN errors / count > 0.1 THEN 'error_rate > ' || CAST(errors / count AS VARCHAR) || ' FIRING (threshold: 0.1)' ELSE printf('error_rate = %.4f (threshold: > 0.1)', errors / count) END AS message FROM w
        UNION ALL SELECT 'r7', service_id, sec, CASE WHEN before = 0 THEN 'no previous window data' ELSE printf('request_count: previous=%.2f, current=%.2f, change=%.1f%% (threshold: -20.0%%)', CAST(before AS DOUBLE), CAST(now AS DOUBLE), (now - before) / before * 100.0) END FROM j""",
    "every_nth_span": "SELECT event_id AS arrival_seq, 'svc_' || (user_id % 4) AS service_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS sec FROM events QUALIFY row_number() OVER (ORDER BY event_id) % 50 = 0",
    "health": f"SELECT 'ok' AS status, '{api.VERSION}' AS version, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) AS orders",
    "cooldown_fixed": f"{SPOKE} SELECT 'r1' AS rule_id, f.service_id, f.sec, f.fingerprint FROM f JOIN spoke USING (fingerprint, sec)",
    "alert_event_filter": f"""{BASE}, {_frame('w', W, 0)}, {CHANGED}, one AS ({R1}),
        fired AS (SELECT rule_id, service_id, severity, sec, fingerprint, 48 AS cooldown FROM one WHERE fired UNION ALL SELECT 'r7', service_id, 'info', sec, {_finger('r7', 'info')}, 24 FROM ch WHERE fired),
        spoke AS (SELECT * FROM (SELECT *, sec - lag(sec) OVER (PARTITION BY fingerprint ORDER BY sec) AS gap FROM fired) WHERE gap IS NULL OR gap >= cooldown),
        numbered AS (SELECT *, row_number() OVER (ORDER BY sec, fingerprint) AS n FROM spoke)
        SELECT 'evt_' || n AS id, rule_id, service_id, severity, 'firing' AS status, TIMESTAMP '1970-01-01' + to_seconds(sec) AS fired_at FROM numbered WHERE severity = 'info' ORDER BY sec, n LIMIT 20""",
    "rule_create": f"""{NAMED}, good AS (SELECT *, 'new ' || id || ' ' || name AS fresh FROM r WHERE k = 0 OR k = 5), top AS (SELECT max(CAST(substr(id, 6) AS BIGINT)) AS last FROM r WHERE severity = 'info')
        SELECT id, name, false AS enabled, CAST(7 AS BIGINT) AS cooldown_secs FROM r WHERE severity = 'info'
        UNION ALL SELECT 'rule_' || (last + row_number() OVER (ORDER BY project_id, fresh)), fresh, true, CAST(CASE WHEN length(id) % 2 = 0 THEN 60 ELSE 300 END AS BIGINT) FROM good, top""",
    "rule_get": f"{NAMED} SELECT id, name, severity FROM r WHERE id = 'rule_42'",
    "rules_of_project": f"{NAMED} SELECT id, name, severity FROM r WHERE project_id = 'BUILDING'",
    "rule_duplicates": f"{NAMED} SELECT project_id, name, count(*) AS count FROM r GROUP BY ALL HAVING count(*) > 1",
    "rule_lookback": "SELECT c_custkey AS id, CAST(CASE c_custkey % 3 WHEN 0 THEN c_custkey % 600 WHEN 1 THEN c_custkey % 7000 ELSE 2 * (c_custkey % 600) END AS BIGINT) AS lookback FROM customer",
    "anomaly_messages": f"""{BASE}, {_frame("b", 168, W)}, {_frame("c", W, 0)}, j AS (SELECT b.service_id, b.sec, len(b.samples) AS n, {RATE.replace("count", "b.count").replace("errors", "b.errors")} AS base, {RATE.replace("count", "c.count").replace("errors", "c.errors")} AS cur,
            CASE WHEN b.count > 0 THEN sqrt((b.errors / b.count) * (1 - b.errors / b.count) / b.count) ELSE CAST(0 AS DOUBLE) END AS sd FROM b JOIN c ON b.service_id = c.service_id AND b.sec = c.sec)
        SELECT 'r3' AS rule_id, service_id, sec, CASE WHEN n < 10 THEN 'insufficient baseline data' WHEN sd < 1e-10 THEN 'baseline has zero variance for error_rate'
            ELSE printf('error_rate: current=%.2f, baseline=%.2f, stddev=%.2f, z_score=%.2f (threshold: 1.5)', cur, base, sd, abs(cur - base) / sd) END AS message FROM j""",
    # The window as a list of seconds, one observation of each service a step.
    "late_data": f"""WITH RECURSIVE o AS (SELECT 'svc_' || (user_id % 4) AS service_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) - CASE WHEN event_id % 7 = 0 THEN event_id % 60 ELSE 0 END AS sec, event_id AS arrival_seq FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY arrival_seq) AS k FROM o),
        w AS (SELECT service_id, sec, arrival_seq, k, [sec] AS held, true AS taken FROM n WHERE k = 1
            UNION ALL SELECT n.service_id, n.sec, n.arrival_seq, n.k,
                CASE WHEN n.sec > w.held[-1] THEN list_concat(w.held, range(w.held[-1] + 1, w.held[-1] + least(n.sec - w.held[-1], {W})), [n.sec])[-{W}:] ELSE w.held END, n.sec > w.held[-1] OR list_contains(w.held, n.sec)
            FROM w JOIN n ON n.service_id = w.service_id AND n.k = w.k + 1)
        SELECT service_id, sec, arrival_seq FROM w WHERE taken""",
    "bucket_1s": BASE + SAMPLES_OUT,
    "bucket_first_samples": OBS.format(cap=3) + SAMPLES_OUT,
    "trailing_window": f"{BASE}, {_frame('w', W, 0)} SELECT service_id, sec, count AS w_count, errors AS w_errors, sum_us AS w_sum_us, min_us AS w_min_us, max_us AS w_max_us FROM w",
    "range_window": f"{BASE}, {_frame('w', 2 * W, W)} SELECT service_id, sec, count AS w_count, errors AS w_errors, sum_us AS w_sum_us FROM w",
    "nearest_rank_percentile": f"{BASE}, {_frame('w', W, 0)} SELECT service_id, sec, {_rank(0.5)} AS p50, {_rank(0.95)} AS p95, {_rank(0.99)} AS p99 FROM w",
    "zscore_baseline": f"""{BASE}, {_frame('b', 168, W)} SELECT service_id, sec, CAST(len(samples) AS INTEGER) AS n, round(coalesce(list_avg(samples), 0), 3) AS mean,
        round(CASE WHEN len(samples) > 1 THEN list_stddev_samp(samples) ELSE CAST(0 AS DOUBLE) END, 3) AS stddev FROM b""",
    "rate_of_change": _change("r7", "info", -20.0, "<="),
    "rate_rule": _change("r4", "info", 20.0, ">=", "service_id = 'svc_2'"),
    "threshold_rule": f"{BASE}, {_frame('w', W, 0)} {R1}",
    "threshold_newest": f"""{BASE}, {_frame('a', W, 0)}, w AS (SELECT * FROM a QUALIFY sec = max(sec) OVER (PARTITION BY service_id)) {R1} UNION ALL
        {_threshold('r2', 'warning', _rank(0.95), '>=', 40000.0, 5, "service_id = 'svc_1'")}""",
    "anomaly_rule": _anomaly("r3", RATE.replace("count", "b.count").replace("errors", "b.errors"), RATE.replace("count", "c.count").replace("errors", "c.errors"), "CASE WHEN b.count > 0 THEN sqrt((b.errors / b.count) * (1 - b.errors / b.count) / b.count) ELSE CAST(0 AS DOUBLE) END", 1.5),
    "anomaly_latency_rule": _anomaly("r8", _rank(0.5, "b.samples"), _rank(0.5, "c.samples"), "CASE WHEN len(b.samples) > 1 THEN list_stddev_samp(b.samples) ELSE CAST(0 AS DOUBLE) END", 0.05),
    "rule_service_scope": """WITH s AS (SELECT DISTINCT 'svc_' || (user_id % 4) AS watched_service FROM events),
        r(id, name, scope) AS (VALUES ('r1', 'errors', ''), ('r2', 'slow', 'svc_1'), ('r3', 'odd errors', ''), ('r4', 'more traffic', 'svc_2'), ('r7', 'less traffic', ''), ('r8', 'odd latency', ''))
        SELECT id, name, watched_service FROM r JOIN s ON scope = '' OR scope = watched_service""",
    "cooldown_emit": f"{FIRED} SELECT rule_id, service_id, sec, fingerprint FROM (SELECT *, sec - lag(sec) OVER (PARTITION BY fingerprint ORDER BY sec) AS gap FROM f) WHERE gap IS NULL OR gap >= 48",
    "stale_resolve": f"{FIRED} SELECT fingerprint, rule_id, service_id, max(sec) AS last_fired FROM f GROUP BY ALL HAVING 474500 - max(sec) >= 429",
    "rule_validation": f"""{CANDIDATES} SELECT id, CASE k WHEN 0 THEN 'name must be 1 to 256 bytes' WHEN 1 THEN 'name must be 1 to 256 bytes' WHEN 2 THEN 'project_id is over 128 bytes' WHEN 3 THEN 'unknown rule_type' WHEN 4 THEN 'unknown severity' END AS problem FROM c""",
    "rule_delete_cascade": f"{CANDIDATES} SELECT 'rule_' || o_custkey AS rule_id, o_orderkey AS event FROM orders WHERE 'rule_' || o_custkey IN (SELECT id FROM c WHERE k <> 4)",
    "rule_update": f"{CANDIDATES} SELECT id, CASE WHEN k = 4 THEN 'critical' ELSE 'info' END AS severity, k = 4 AS enabled FROM c",
}

QUERIES = {f.__name__: f for f in (
    bucket_1s, bucket_first_samples, trailing_window, range_window, nearest_rank_percentile, zscore_baseline, rate_of_change, threshold_rule, threshold_newest,
    anomaly_rule, anomaly_latency_rule, rate_rule, rule_service_scope, cooldown_emit, cooldown_fixed, stale_resolve, alert_event_filter, rule_validation, rule_delete_cascade, rule_update,
    alert_messages, every_nth_span, late_data, stream_verdicts, stream_alert_events, health, rule_create, rule_get, rules_of_project, rule_duplicates, rule_lookback, anomaly_messages,
)}
