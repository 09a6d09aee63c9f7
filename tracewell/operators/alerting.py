"""Alert rules over sliding windows of one-second buckets.

Buckets are aggregates per (project, service, second), so windows read few rows whatever the
traffic; frames are ranges over seconds, which gaps don't disturb. Buckets keep the first
samples of their second in arrival order, as quantiles and spreads are over those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.spans import compare, fingerprint, ratio
from tracewell.operators import sliding
from tracewell.operators.rules import number_of

KEYS = ["project_id", "service_id"]
SAMPLES = 100
LATENCIES = {"p99_latency_us": 0.99, "p95_latency_us": 0.95, "p50_latency_us": 0.5}


def buckets(observations: DataFrame, samples: int | None = SAMPLES, gather: bool = True) -> DataFrame:
    """count, errors, sum, min, max and the first samples of each second; samples None: all.

    gather False: without the samples themselves, whose number follows from the count; no row is ordered then.
    """
    whole = [F.count(F.lit(1)).alias("count"), F.count_if("is_error").alias("errors"), F.sum("duration_us").alias("sum_us"), F.min("duration_us").alias("min_us"), F.max("duration_us").alias("max_us")]
    if not gather:
        n = F.count("duration_us")
        return observations.groupBy(*KEYS, "sec").agg(*whole, (n if samples is None else F.least(n, F.lit(samples))).alias("s_n"))
    if samples is not None:
        order = Window.partitionBy(*KEYS, "sec").orderBy("arrival_seq")
        observations = observations.withColumn("_n", F.row_number().over(order))
    kept = F.col("duration_us") if samples is None else F.when(F.col("_n") <= samples, F.col("duration_us"))
    return observations.groupBy(*KEYS, "sec").agg(
        *whole, F.array_sort(F.collect_list(kept)).alias("samples"),
        F.count(kept).alias("s_n"), F.sum(kept).alias("s_sum"), F.sum(kept.cast("decimal(18,0)") * kept.cast("decimal(18,0)")).cast("decimal(38,0)").alias("s_squares"),
    )


def over_range(bucket_rows: DataFrame, frames: dict[str, tuple[int, int]], latencies: bool = True) -> DataFrame:
    """Aggregates of the seconds in (sec - a, sec - b] for each named frame (a, b), at every bucket.

    If the buckets have samples, of them too: their number, sums and, as {frame}_{metric}, the
    latencies by nearest rank (not without latencies); the samples themselves are left out then.
    """
    sampled = "samples" in bucket_rows.columns
    out = sliding.with_sums(bucket_rows, KEYS, ["count", "errors", "sum_us", "s_n", *(["s_sum", "s_squares"] if sampled else [])], frames)
    out = sliding.with_extremes(out, KEYS, "min_us", "max_us", frames)
    if not sampled:
        return out
    out = out.withColumns({f"{name}_s_squares": F.col(f"{name}_s_squares").cast("decimal(38,0)") for name in frames})
    return sliding.with_quantiles(out, KEYS, "samples", frames, LATENCIES) if latencies else out.drop("samples")


def accepted(observations: DataFrame, capacity: int = 3600, chunk: int = 100_000) -> DataFrame:
    """The observations that a window of so many one-second buckets takes; others come too late.

    A newer second adds buckets up to itself, at most capacity of them: after a longer gap those
    right after the former newest second, and its own. The oldest buckets go beyond capacity. A late
    observation counts if its second has a bucket at that moment. Buckets are numbered as they are
    made, so that one is still there if fewer than capacity came after it.

    The newest second runs on within chunks of arrival numbers, from what the chunks before reached,
    so that no task orders a service. All else follows from tables of one row a second.
    """
    rows = observations.withColumn("_part", F.floor(F.col("arrival_seq") / chunk))
    # One row a chunk of a service.
    chunks = Window.partitionBy(*KEYS).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.groupBy(*KEYS, "_part").agg(F.max("sec").alias("_reached")).withColumn("_reached", F.max("_reached").over(chunks))
    arrival = Window.partitionBy(*KEYS, "_part").orderBy("arrival_seq")
    rows = _with(rows, reached, [*KEYS, "_part"])
    rows = rows.withColumn("_newest", F.greatest("_reached", F.max("sec").over(arrival.rowsBetween(Window.unboundedPreceding, -1))))
    gap = F.col("sec") - F.col("_newest")
    rows = rows.withColumn("_made", F.when(F.col("_newest").isNull(), F.lit(1)).when(gap > 0, F.least(gap, F.lit(capacity)))).drop("_part", "_reached")
    # One row a second of a service: the buckets that were made up to it where it was the newest when it came, and of such
    # seconds the first that isn't before it.
    first = F.max(F.when(F.col("_made").isNotNull(), F.struct("_newest", "_made")))
    seconds = rows.where("sec IS NOT NULL").groupBy(*KEYS, "sec").agg(first.alias("_first"))
    rising, falling = Window.partitionBy(*KEYS).orderBy("sec"), Window.partitionBy(*KEYS).orderBy(F.desc("sec"))
    seconds = seconds.withColumn("_number", F.sum(F.coalesce("_first._made", F.lit(0))).over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    step = F.last(F.when(F.col("_first").isNotNull(), F.struct("sec", "_first._newest", "_first._made", "_number")), ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seconds = seconds.withColumn("_step", step)
    at = F.when(F.col("sec") == F.col("_step.sec"), F.col("_step._number")).when(F.col("sec") - F.col("_step._newest") < F.col("_step._made"), F.col("_step._number") - F.col("_step._made") + F.col("sec") - F.col("_step._newest"))
    places = seconds.select(*KEYS, "sec", at.alias("_at"))
    rows = _with(rows, places, [*KEYS, "sec"])
    rows = _with(rows, seconds.select(*KEYS, F.col("sec").alias("_newest"), "_number"), [*KEYS, "_newest"])
    return rows.where(F.col("_made").isNotNull() | (F.col("_number") - F.col("_at") < capacity)).select(*observations.columns)


def _with(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of more, which has at most one row a key; a null key is one as others."""
    named = more.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])


def trailing(bucket_rows: DataFrame, seconds: int, name: str = "w") -> DataFrame:
    return over_range(bucket_rows, {name: (seconds, 0)})


def newest(rows: DataFrame) -> DataFrame:
    """The row of each service's newest second: windows end there, not at the wall clock."""
    return rows.withColumn("_last", F.max("sec").over(Window.partitionBy(*KEYS))).where("sec = _last").drop("_last")


def rank_of(n: int, p: float) -> int:
    """The nearest rank ceil(n p), from 1."""
    return max(1, min(n, math.ceil(n * p)))


def mean_of(name: str) -> Column:
    """Mean of the samples of a frame, 0 without any."""
    return ratio(F.col(f"{name}_s_sum"), F.col(f"{name}_s_n"))


def spread_of(name: str) -> Column:
    """Sample standard deviation of a frame, 0 for fewer than two samples; from exact whole sums."""
    n, total, squares = (F.col(f"{name}_{c}") for c in ("s_n", "s_sum", "s_squares"))
    whole = n.cast("decimal(12,0)") * squares.cast("decimal(26,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    return F.when(n > 1, F.sqrt(whole.cast("double") / (n.cast("double") * (n - 1)))).otherwise(F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """value with so many decimals, rounded by what the double stands for exactly (0.175 lies below its half); true halves to the even digit."""
    scale, x = float(10**digits), F.abs(value)
    # x * scale as a double and what that leaves out, from x in two parts of 26 bits.
    product, wide = x * scale, x * 134217729.0
    high = wide - (wide - x)
    rest = (high * scale - product) + (x - high) * scale
    low = F.floor(product)
    half = product - low
    up = (half > 0.5) | ((half == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
    rounded = F.when(x < 1e15 / scale, (low + up.cast("bigint")) / scale).otherwise(x)
    return F.format_string(f"%.{digits}f", F.when(value < 0, -rounded).otherwise(rounded))


def metric_of(metric: str, name: str) -> Column:
    """Value of a metric over the frame of that name."""
    count, errors = F.col(f"{name}_count"), F.col(f"{name}_errors")
    if metric == "error_rate":
        return ratio(errors, count)
    if metric == "request_count":
        return count.cast("double")
    return F.col(f"{name}_{metric}")


def metric_spread(metric: str, name: str) -> Column:
    count = F.col(f"{name}_count")
    if metric == "error_rate":
        rate = ratio(F.col(f"{name}_errors"), count)
        return F.when(count > 0, F.sqrt(rate * (1 - rate) / count)).otherwise(F.lit(0.0))
    return count * 0.1 if metric == "request_count" else spread_of(name)


def for_services(rules: DataFrame, services: DataFrame) -> DataFrame:
    """Enabled rules with the services they watch: their own, or all of their project if blank; both by equal keys."""
    watched = services.select(F.col("project_id").alias("_p"), F.col("service_id").alias("watched_service"))
    on = rules.where("enabled")
    same = F.col("project_id") == F.col("_p")
    scoped = on.where("service_id <> ''").join(watched, same & (F.col("service_id") == F.col("watched_service")))
    return scoped.unionByName(on.where("service_id = ''").join(watched, same)).drop("_p")


def evaluate(observations: DataFrame, rules: DataFrame, rule_rows: list, every_second: bool = False, samples: int | None = SAMPLES) -> DataFrame:
    """Verdicts of the rules at each service's newest second, or at every second that has a bucket.

    rule_rows: the rules as dicts, known to the caller (rules are few); those that the table rules
    has and that are on count. All of them are answered in one pass over the buckets, which keep
    samples only if some rule looks at latencies.
    """
    rows = over_range(buckets(observations, samples, any(r["metric"] in LATENCIES for r in rule_rows)), frames_of(rule_rows))
    if not every_second:
        rows = newest(rows)
    on = rules.where("enabled").select(F.col("id").alias("rule_id"))
    return judged(rows, rule_rows).join(on, "rule_id", "left_semi")


def frames_of(rule_rows: list[dict]) -> dict[str, tuple[int, int]]:
    """The frames that rules look at, by name."""
    frames: dict[str, tuple[int, int]] = {}
    for r in rule_rows:
        if r["rule_type"] == "threshold":
            frames[_frame(r["window_secs"], 0)] = (r["window_secs"], 0)
        elif r["rule_type"] == "anomaly":
            b, e = r["baseline_window_secs"], r["evaluation_window_secs"]
            frames |= {_frame(b, e): (b, e), _frame(e, 0): (e, 0)}
        else:
            w = r["window_secs"]
            frames |= {_frame(2 * w, w): (2 * w, w), _frame(w, 0): (w, 0)}
    return frames


def judged(rows: DataFrame, rule_rows: list[dict]) -> DataFrame:
    """Verdicts of the rules on rows with the aggregates of their frames."""
    found = []
    for r in rule_rows:
        fields = {"rule_id": F.lit(r["id"]), "rule_name": F.lit(r["name"]), "severity": F.lit(r["severity"]), "cooldown_secs": F.lit(r["cooldown_secs"]).cast("bigint")} | _verdict(r)
        scope = (F.col("project_id") == r["project_id"]) & (F.lit(r["service_id"] == "") | (F.col("service_id") == r["service_id"]))
        found.append(F.when(scope, F.struct(*[v.alias(k) for k, v in fields.items()])))
    out = rows.select("project_id", "service_id", "sec", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"))
    out = out.select("v.rule_id", "v.rule_name", "project_id", "service_id", "v.severity", "v.cooldown_secs", "sec", "v.fired", "v.metric_value", "v.threshold_value", "v.message")
    return out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("service_id"), F.col("severity")))


def _frame(a: int, b: int) -> str:
    return f"f{a}_{b}"


def _verdict(r: dict) -> dict[str, Column]:
    metric = r["metric"]
    shown = F.lit(metric)
    if r["rule_type"] == "threshold":
        name = _frame(r["window_secs"], 0)
        limit, least, operator = F.lit(float(r["value"])), F.lit(r["min_requests"]).cast("bigint"), F.lit(r["operator"])
        enough = F.col(f"{name}_count") >= least
        value = F.when(enough, metric_of(metric, name)).otherwise(F.lit(0.0))
        fired = enough & compare(operator, value, limit)
        message = (
            F.when(~enough, F.format_string("insufficient data: %d requests < %d min_requests", F.col(f"{name}_count"), least))
            .when(fired, F.concat_ws(" ", shown, operator, value.cast("string"), F.lit("FIRING"), F.concat(F.lit("(threshold: "), limit.cast("string"), F.lit(")"))))
            .otherwise(F.format_string("%s = %s (threshold: %s %s)", shown, fixed(value, 4), operator, limit.cast("string")))
        )
        return {"fired": fired, "metric_value": value, "threshold_value": limit, "message": message}
    if r["rule_type"] == "anomaly":
        b, e = r["baseline_window_secs"], r["evaluation_window_secs"]
        limit = F.lit(float(r["z_score_threshold"]))
        base, current = metric_of(metric, _frame(b, e)), metric_of(metric, _frame(e, 0))
        spread = metric_spread(metric, _frame(b, e))
        enough = F.col(f"{_frame(b, e)}_s_n") >= 10
        varied = spread >= 1e-10
        z = F.abs(current - base) / F.when(varied, spread)
        fired = enough & varied & F.coalesce(z > limit, F.lit(False))
        message = (
            F.when(~enough, F.lit("insufficient baseline data"))
            .when(~varied, F.concat(F.lit("baseline has zero variance for "), shown))
            .otherwise(F.format_string("%s: current=%s, baseline=%s, stddev=%s, z_score=%s (threshold: %s)", shown, fixed(current, 2), fixed(base, 2), fixed(spread, 2), fixed(z, 2), fixed(limit, 1)))
        )
        return {
            "fired": fired,
            "metric_value": F.when(enough, current).otherwise(F.lit(0.0)),
            "threshold_value": F.when(enough & varied, base).otherwise(limit),
            "message": message,
        }
    w = r["window_secs"]
    before, now = metric_of(metric, _frame(2 * w, w)), metric_of(metric, _frame(w, 0))
    some = F.col(f"{_frame(2 * w, w)}_count") > 0
    small = 1e-10
    change = F.when(F.abs(before) < small, F.when(F.abs(now) < small, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise((now - before) / F.when(F.abs(before) >= small, before) * 100.0)
    limit = F.lit(float(r["change_threshold_pct"]))
    fired = some & (change <= limit if r["change_threshold_pct"] < 0 else change >= limit)
    message = F.when(~some, F.lit("no previous window data")).otherwise(F.format_string("%s: previous=%s, current=%s, change=%s%% (threshold: %s%%)", shown, fixed(before, 2), fixed(now, 2), fixed(change, 1), fixed(limit, 1)))
    return {"fired": fired, "metric_value": now, "threshold_value": F.when(some, before).otherwise(limit), "message": message}


def emitted(verdicts: DataFrame, mode: str = "sliding") -> DataFrame:
    """Fired verdicts that become alerts.

    sliding: one is silent if the last fired verdict of its fingerprint, silent or not, is
    less than the cooldown ago, so that an alert that stays on speaks once. fixed: the time
    runs from the last alert that spoke.
    """
    fired = verdicts.where("fired")
    own = Window.partitionBy("fingerprint").orderBy("sec")
    if mode == "sliding":
        last = F.lag("sec").over(own)
        return fired.withColumn("_gap", F.col("sec") - last).where("_gap IS NULL OR _gap >= cooldown_secs").drop("_gap")
    # A fold over the seconds of a fingerprint, once; what spoke is a short list.
    none = F.array().cast("array<bigint>")
    cooldown = F.max("cooldown_secs").alias("c")
    seconds = fired.groupBy("fingerprint").agg(F.array_sort(F.collect_set(F.col("sec").cast("bigint"))).alias("secs"), cooldown)
    spoke = F.aggregate("secs", none, lambda done, x: F.when((F.size(done) == 0) | (x - F.try_element_at(done, F.lit(-1)) >= F.col("c")), F.array_append(done, x)).otherwise(done))
    told = seconds.select(F.col("fingerprint").alias("_f"), F.explode(spoke).alias("_sec"))
    return fired.join(told, (F.col("fingerprint") == F.col("_f")) & (F.col("sec") == F.col("_sec")), "left_semi")


def stale(verdicts: DataFrame, as_of_sec: int, max_age: int) -> DataFrame:
    """Fingerprints whose last firing is at least max_age ago, with that time."""
    return verdicts.where("fired").groupBy("fingerprint", "rule_id", "service_id").agg(F.max("sec").alias("last_fired")).where(F.lit(as_of_sec) - F.col("last_fired") >= max_age)


def alert_events(found: DataFrame) -> DataFrame:
    """Alerts as stored events, numbered in time order with the fingerprint for ties."""
    own = Window.partitionBy("project_id").orderBy("sec", "fingerprint")
    return found.select(F.concat(F.lit("evt_"), F.row_number().over(own).cast("string")).alias("id"), "rule_id", "rule_name", "project_id", "service_id", "severity", F.lit("firing").alias("status"), "message", "metric_value", "threshold_value", F.timestamp_seconds("sec").alias("fired_at"), F.lit(None).cast("timestamp").alias("resolved_at"))


def list_events(events: DataFrame, project: str, status: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
    found = events.where(F.col("project_id") == project)
    if status is not None:
        found = found.where(F.col("status") == status)
    if severity is not None:
        found = found.where(F.col("severity") == severity)
    return found.orderBy("fired_at", number_of("id")).limit(limit)


def every_nth(observations: DataFrame, n: int = 50, chunk: int = 1_000_000) -> DataFrame:
    """The observations at which rules are evaluated: every nth over all services, by arrival_seq (which is unique).

    Counted in chunks of arrival numbers, so that no task orders all rows.
    """
    part = F.floor(F.col("arrival_seq") / chunk)
    sizes = observations.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row a chunk.
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("arrival_seq"))
    placed = observations.withColumn("_part", part).withColumn("_place", place).join(before, "_part")
    return placed.where((F.col("_before") + F.col("_place")) % n == 0).drop("_part", "_place", "_before")
