"""Alert windows, verdicts and alerts' lives as keyed state of a stream.

Two stateful operators in a row. The first has a window of one-second buckets for each
(project, service): a map of buckets in the state store and the stretches of seconds that have
one, empty ones included, so that late observations count exactly where their second still has
a bucket. No observation is read twice; after each batch a service with new ones gives the
aggregates of its frames at its newest second, from which alerting.judged makes the verdicts.
The second operator has one entry an alert: it speaks by cooldown, and an event-time timer
resolves what has not fired for max_age.

State is in RocksDB (rocksdb()). The first operator takes observations however late they are,
as its buckets decide; the watermark only moves the timers. A service's observations of one
batch meet in one task, whose size the stream's rate limit bounds (max_bytes_per_trigger,
maxFilesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators import alerting

KEYS = alerting.KEYS
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Ring:
    """The seconds that have a bucket, as stretches; at most capacity of them."""

    def __init__(self, capacity: int, stretches: list[tuple[int, int]] | None = None):
        self.capacity = capacity
        self.stretches = list(stretches or [])

    @property
    def newest(self) -> int | None:
        return self.stretches[-1][1] if self.stretches else None

    def __contains__(self, sec: int) -> bool:
        return any(low <= sec <= high for low, high in self.stretches)

    def takes(self, sec: int) -> bool:
        """Whether an observation of that second has a bucket; a newer second makes buckets up to its own.

        After a gap longer than capacity they are those right after the former newest and its own.
        """
        if self.newest is None:
            self.stretches = [(sec, sec)]
            return True
        if sec <= self.newest:
            return sec in self
        low, high = self.stretches[-1]
        filled = high + min(sec - high, self.capacity) - 1
        self.stretches[-1:] = [(low, sec)] if filled == sec - 1 else [(low, filled), (sec, sec)]
        over = sum(b - a + 1 for a, b in self.stretches) - self.capacity
        while over > 0:
            a, b = self.stretches[0]
            gone = min(over, b - a + 1)
            self.stretches[:1] = [(a + gone, b)] if a + gone <= b else []
            over -= gone
        return True


BUCKET = "count long, errors long, sum_us long, min_us long, max_us long, samples array<long>"


class Windows(StatefulProcessor):
    """Buckets of one service; gives the aggregates of the frames at its newest second after each batch."""

    def __init__(self, frames: dict[str, tuple[int, int]], capacity: int, samples: int):
        self.frames, self.capacity, self.samples = frames, capacity, samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seconds = handle.getValueState("seconds", "lows array<long>, highs array<long>")
        self.buckets = handle.getMapState("buckets", "sec long", BUCKET)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(list(rows)).dropna(subset=["sec"]).sort_values("arrival_seq", kind="stable")
        if given.empty:
            return
        found = self.seconds.get()
        ring = Ring(self.capacity, list(zip(found[0], found[1])) if found else None)
        kept = {k[0]: [*v[:5], list(v[5])] for k, v in self.buckets.iterator()}
        touched = set()
        for sec, duration, error in zip(given["sec"].tolist(), given["duration_us"].tolist(), given["is_error"].tolist()):
            sec = int(sec)
            if not ring.takes(sec):
                continue
            touched.add(sec)
            b = kept.setdefault(sec, [0, 0, None, None, None, []])
            if not pd.isna(duration):
                duration = int(duration)
                b[2:5] = (duration, duration, duration) if b[2] is None else (b[2] + duration, min(b[3], duration), max(b[4], duration))
                if b[0] < self.samples:
                    b[5].append(duration)
            b[0] += 1
            b[1] += error is True
        for sec in [x for x in kept if x not in ring]:
            del kept[sec]
            if self.buckets.containsKey((sec,)):
                self.buckets.removeKey((sec,))
        for sec in touched & kept.keys():
            self.buckets.updateValue((sec,), tuple(kept[sec]))
        self.seconds.update(([a for a, _ in ring.stretches], [b for _, b in ring.stretches]))
        yield pd.DataFrame([{**dict(zip(KEYS, key)), "sec": ring.newest, **self._aggregates(ring.newest, kept)}])

    def _aggregates(self, newest: int, kept: dict[int, list]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name, (a, b) in self.frames.items():
            own = [x for sec, x in kept.items() if newest - a < sec <= newest - b]
            with_time = [x for x in own if x[2] is not None]
            samples = sorted(s for x in own for s in x[5])
            out |= {
                f"{name}_count": sum(x[0] for x in own), f"{name}_errors": sum(x[1] for x in own), f"{name}_sum_us": sum(x[2] for x in with_time),
                f"{name}_min_us": min((x[3] for x in with_time), default=None), f"{name}_max_us": max((x[4] for x in with_time), default=None),
                f"{name}_s_n": len(samples), f"{name}_s_sum": sum(samples), f"{name}_s_squares": str(sum(x * x for x in samples)),
            }
            for metric, p in alerting.LATENCIES.items():
                out[f"{name}_{metric}"] = float(samples[alerting.rank_of(len(samples), p) - 1]) if samples else 0.0
        return out


def window_rows(observations: DataFrame, rule_rows: list[dict], capacity: int = 3600, samples: int = alerting.SAMPLES) -> DataFrame:
    """project_id, service_id, sec and the aggregates of all frames of the rules, once a batch for every service in it."""
    frames = alerting.frames_of(rule_rows)
    whole = ("count", "errors", "sum_us", "min_us", "max_us", "s_n", "s_sum")
    fields = [f"{f}_{c} long" for f in frames for c in whole] + [f"{f}_s_squares string" for f in frames] + [f"{f}_{m} double" for f in frames for m in alerting.LATENCIES]
    given = observations.select(*KEYS, "sec", "duration_us", "is_error", "arrival_seq")
    rows = given.groupBy(*KEYS).transformWithStateInPandas(Windows(frames, capacity, samples), ", ".join([f"{k} string" for k in KEYS] + ["sec long", *fields]), "append", "none")
    return rows.withColumns({f"{f}_s_squares": F.col(f"{f}_s_squares").cast("decimal(38,0)") for f in frames})


def verdict_stream(observations: DataFrame, rule_rows: list[dict], capacity: int = 3600, samples: int = alerting.SAMPLES) -> DataFrame:
    """Verdicts of the rules at the newest second of every service of a batch, over the window as of that batch."""
    return alerting.judged(window_rows(observations, rule_rows, capacity, samples), [r for r in rule_rows if r["enabled"]])


EVENT = "fingerprint string, rule_id string, rule_name string, project_id string, service_id string, severity string, status string, message string, metric_value double, threshold_value double, fired_at timestamp, resolved_at timestamp"
SHOWN = [x.split()[0] for x in EVENT.split(", ")]


def _time(sec: int | None) -> datetime | None:
    return None if sec is None else datetime.fromtimestamp(sec, timezone.utc).replace(tzinfo=None)


class Lives(StatefulProcessor):
    """One alert by fingerprint: silent, firing, then resolved and forgotten once max_age has passed since it last fired."""

    def __init__(self, max_age: int, mode: str):
        if mode not in ("sliding", "fixed"):
            raise ValueError(f"no cooldown mode {mode}")
        self.max_age, self.mode = max_age, mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "first long, last long, spoke long, rule_id string, rule_name string, project_id string, service_id string, severity string, message string, metric_value double, threshold_value double")

    def _row(self, fingerprint: str, told: tuple, status: str, fired: int, resolved: int | None) -> dict[str, Any]:
        return dict(zip(SHOWN, (fingerprint, *told[:5], status, *told[5:], _time(fired), _time(resolved))))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, found = [], self.alert.get() if self.alert.exists() else None
        first, last, spoke, told = (found[0], found[1], found[2], tuple(found[3:])) if found else (None, None, None, None)
        before = last
        for r in pd.concat(list(rows)).sort_values("sec", kind="stable").itertuples(index=False):
            sec = int(r.sec)
            if last is not None and sec - last >= self.max_age:
                out.append(self._row(key[0], told, "resolved", first, last + self.max_age))
                last = None
            told = (r.rule_id, r.rule_name, r.project_id, r.service_id, r.severity, r.message, r.metric_value, r.threshold_value)
            if last is None:
                first = spoke = sec
                out.append(self._row(key[0], told, "firing", sec, None))
            elif sec - (last if self.mode == "sliding" else spoke) >= r.cooldown_secs:
                spoke = sec
                out.append(self._row(key[0], told, "firing", sec, None))
            last = sec if last is None else max(last, sec)
        if before is not None:
            self.handle.deleteTimer((before + self.max_age) * 1000)
        self.handle.registerTimer((last + self.max_age) * 1000)
        self.alert.update((first, last, spoke, *told))
        if out:
            yield pd.DataFrame(out, columns=SHOWN)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.alert.exists():
            return
        first, last, _, *told = self.alert.get()
        # Only the timer of the last firing counts.
        if expiredTimerInfo.getExpiryTimeInMs() >= (last + self.max_age) * 1000:
            self.alert.clear()
            yield pd.DataFrame([self._row(key[0], tuple(told), "resolved", first, last + self.max_age)], columns=SHOWN)


def alert_stream(observations: DataFrame, rule_rows: list[dict], max_age: int, delay: str = "0 seconds", capacity: int = 3600, mode: str = "sliding", samples: int = alerting.SAMPLES) -> DataFrame:
    """Alerts as they fire and as they resolve, max_age seconds of event time after they last fired.

    The watermark is the newest second of all services less delay.
    """
    timed = observations.withColumn("event_time", F.timestamp_seconds("sec")).withWatermark("event_time", delay)
    fired = verdict_stream(timed, rule_rows, capacity, samples).where("fired")
    return fired.groupBy("fingerprint").transformWithStateInPandas(Lives(max_age, mode), EVENT, "append", "eventTime")
