"""Alert rules, notification limits and escalation on streams, with the same results as the batch forms.

Conditions are evaluated in the JVM and the last reading of every evaluation
interval is kept by a windowed aggregate (partial aggregation first, so a hot
key sends one row per interval and task). Only these rows reach the keyed
state, closed interval by closed interval and therefore in time order. Inside,
whole arrays of rows are worked on; only picks that the cooldown lets through are met one by one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zonelytics.operators.rules import Rule, evaluated
from zonelytics.streaming.ingest import DEFAULT_DELAY, event_time

# ship the processors themselves to the workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _apart(times: np.ndarray, last: int | None, gap: int) -> list[int]:
    """The greedy picks of rising ``times`` that are ``gap`` or more after ``last`` and each other."""
    picks, at = [], 0 if last is None else int(np.searchsorted(times, last + gap))
    while at < len(times):
        picks.append(int(times[at]))
        at = max(at + 1, int(np.searchsorted(times, times[at] + gap)))
    return picks


class RuleProcessor(StatefulProcessor):
    """State per key: one row of times (last reading, last alert, last alert shown), a map of the branches' runs, a list of open alerts.

    As in the batch form, alerts that pass the cooldown are thinned again by the
    duplicate window where that is longer. An alert still open ``keep`` days after it
    fired leaves the state and stays unresolved, so a rule that never resolves holds a bounded list.
    """

    def __init__(self, rule: Rule, dedup: int = 300, keep: int = 30):
        self.sustain = [b.sustain * 1_000_000 for b in rule.branches]
        self.names = [b.name for b in rule.branches]
        self.gap = rule.gap * 1_000_000
        self.cooldown = rule.cooldown * 1_000_000
        self.dedup = dedup * 1_000_000 if dedup > rule.cooldown else 0
        self.resolvable = rule.resolve is not None
        self.keep = keep * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "at bigint, last bigint, shown bigint")
        self.runs = handle.getMapState("runs", "branch int", "begun bigint, held boolean")
        self.open = handle.getListState("open", "fired bigint")

    def fires(self, us: np.ndarray, joined: np.ndarray, on: np.ndarray, branch: int) -> np.ndarray:
        """Rows at which a branch has just been true long enough; its run goes on in the state."""
        begun, held = self.runs.getValue((branch,)) if self.runs.containsKey((branch,)) else (None, False)
        start = on & ~(joined & np.append(begun is not None, on[:-1]))
        since = np.maximum.accumulate(np.where(start, np.arange(len(us)), -1))
        first = np.where(since >= 0, us[since], begun or 0)
        long = on & (us - first >= self.sustain[branch])
        if on[-1]:
            self.runs.updateValue((branch,), (int(first[-1]), bool(long[-1])))
        elif begun is not None:
            self.runs.removeKey((branch,))
        return long & (start | ~np.append(held, long[:-1]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("us", kind="stable")
        us, conditions = frame["us"].to_numpy(np.int64), np.array(frame["conditions"].tolist(), bool).reshape(len(frame), -1)
        at, last, shown = self.times.get() if self.times.exists() else (None, None, None)
        joined = np.diff(us, prepend=us[0] if at is None else at) <= self.gap
        joined[0] &= at is not None
        branch = np.full(len(us), -1)
        for i in reversed(range(len(self.names))):
            branch[self.fires(us, joined, conditions[:, i], i)] = i
        picks = shows = _apart(us[branch >= 0], last, self.cooldown)
        if self.dedup:
            shows = _apart(np.array(picks, np.int64), shown, self.dedup)
        out = [pd.DataFrame({"kind": "fired", "fired_us": shows, "resolved_us": None, "branch": [self.names[branch[np.searchsorted(us, t)]] for t in shows]})]
        if self.resolvable:
            waiting = np.array([x[0] for x in self.open.get()] + shows if self.open.exists() else shows, np.int64)
            ends = us[frame["resolved"].to_numpy(bool)]
            end = np.searchsorted(ends, waiting, "right")  # an alert ends at a later reading only
            over = end < len(ends)
            out.append(pd.DataFrame({"kind": "resolved", "fired_us": waiting[over], "resolved_us": ends[end[over]], "branch": None}))
            left = [(int(t),) for t in waiting[~over] if t >= us[-1] - self.keep]
            self.open.put(left) if left else self.open.clear()
        self.times.update((int(us[-1]), picks[-1] if picks else last, shows[-1] if shows else shown))
        both = pd.concat([o.astype({"fired_us": "Int64", "resolved_us": "Int64", "branch": object}) for o in out])
        both.insert(0, "object_id", key[0])
        yield both

    def close(self) -> None:
        pass


def rule_stream(df: DataFrame, rule: Rule, ts: str = "timestamp", tie: tuple[str, ...] = (), delay: str | None = DEFAULT_DELAY, dedup: int = 300) -> DataFrame:
    """Append-only change log: ``fired`` rows, then a ``resolved`` row per alert when it ends. No ``delay``: the stream has its watermark already."""
    rows = evaluated(event_time(df, ts, delay) if delay else df, [rule], ts, tie)
    conditions = F.array(*[F.col(f"_c0_{i}") for i in range(len(rule.branches))])
    last = F.max_by(
        F.struct(F.unix_micros(ts).alias("us"), conditions.alias("conditions"), F.col("_res0").alias("resolved")),
        F.struct(ts, *tie),
    )
    reduced = rows.groupBy(F.col(rule.key).alias("object_id"), F.window(ts, f"{rule.interval} seconds").alias("_w")).agg(last.alias("_r"))
    flat = reduced.select("object_id", "_r.us", "_r.conditions", "_r.resolved")
    return flat.groupBy("object_id").transformWithStateInPandas(
        RuleProcessor(rule, dedup),
        outputStructType="object_id string, kind string, fired_us bigint, resolved_us bigint, branch string",
        outputMode="Append",
        timeMode="None",
    )


def current_alerts(log: DataFrame, rule: Rule) -> DataFrame:
    """The change log folded to one row per alert."""
    return log.groupBy(F.col("object_id").alias(rule.key), F.timestamp_micros("fired_us").alias("timestamp")).agg(
        F.max(F.timestamp_micros("resolved_us")).alias("resolved_at")
    )


class OneTimer:
    """A single event-time timer per key, at the earliest time something is due; its time is kept as state."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("timer", "ms bigint")

    def earliest(self, us: int) -> None:
        """See to it that the timer runs no later than at ``us``."""
        ms, now = -(-int(us) // 1000), self.at.get()[0] if self.at.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.at.update((ms,))

    def expired(self, timerValues, info) -> int:
        """The time up to which everything is due, in microseconds; the timer is gone."""
        self.at.clear()
        return max(info.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000


class FirstOfHour(StatefulProcessor):
    """The first ``n`` rows of a group, whose key holds the hour, in the order of ``ts`` and ``order``.

    A row waits until the watermark has reached its time, so no earlier one can follow. State per group: the waiting
    rows and how many have been let through; once the group is full no row waits.
    """

    def __init__(self, n: int, ts: str, order: list[str], schema: T.StructType):
        self.n, self.ts, self.order, self.columns = n, ts, order, schema.names
        self.fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = OneTimer(handle)
        self.waiting = handle.getListState("waiting", self.fields)
        self.through = handle.getValueState("through", "n int")

    def us(self, frame: pd.DataFrame) -> pd.Series:
        return frame[self.ts].astype("datetime64[us]").astype(np.int64)

    def values(self, frame: pd.DataFrame) -> list[tuple]:
        return list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.through.exists() or self.through.get()[0] < self.n:
            frame = pd.concat(list(rows))[self.columns]
            self.waiting.appendList(self.values(frame))
            self.timer.earliest(self.us(frame).min())
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.timer.expired(timerValues, expiredTimerInfo)
        frame = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.columns)
        due = self.us(frame) <= now
        done = self.through.get()[0] if self.through.exists() else 0
        out = frame[due].sort_values([self.ts, *self.order]).head(self.n - done)
        self.through.update((done + len(out),))
        rest = frame[~due] if done + len(out) < self.n else frame[:0]
        if len(rest):
            self.waiting.put(self.values(rest))
            self.timer.earliest(self.us(rest).min())
        else:
            self.waiting.clear()
        yield out

    def close(self) -> None:
        pass


def throttle_stream(alerts: DataFrame, ts: str = "timestamp", key: str = "zone_id", per_key: int = 3, overall: int = 50, delay: str | None = DEFAULT_DELAY) -> DataFrame:
    """Notification limits on clock hours, as ``rules.throttle``: first per key, then over all keys; two chained stateful steps.

    An alert is let through once the watermark has reached it. No ``delay``: the stream has its watermark already.
    """
    rows = event_time(alerts, ts, delay) if delay else alerts
    last = ["rule", *[c for c in ("branch", "alert_id") if c in alerts.columns]]
    in_hours = lambda df: df.withColumn("_hour", F.date_trunc("hour", ts))
    some = in_hours(rows).groupBy(key, "_hour").transformWithStateInPandas(
        FirstOfHour(per_key, ts, last, rows.schema), outputStructType=rows.schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=ts
    )
    return in_hours(some).groupBy("_hour").transformWithStateInPandas(
        FirstOfHour(overall, ts, [key, *last], rows.schema), outputStructType=rows.schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=ts
    )


class Escalation(StatefulProcessor):
    """State per key and rule: alerts whose time to be acknowledged runs, and recent acknowledgements.

    A timer at the earliest deadline fires when the watermark has passed it, with no further input for the key needed;
    by then every acknowledgement in time has been seen. Acknowledgements are forgotten a deadline after they came.
    """

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timer = OneTimer(handle)
        self.alerts = handle.getListState("alerts", "us bigint, id string")
        self.acks = handle.getListState("acks", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        alert = frame["alert_id"].notna()
        if alert.any():
            self.alerts.appendList(list(zip(frame["us"][alert].tolist(), frame["alert_id"][alert].tolist(), strict=True)))
        if not alert.all():
            self.acks.appendList([(x,) for x in frame["us"][~alert].unique().tolist()])
        self.timer.earliest(frame["us"].min() + self.wait)
        yield pd.DataFrame({"alert_id": [], "fired_us": []}).astype({"alert_id": object, "fired_us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.timer.expired(timerValues, expiredTimerInfo)
        alerts = list(self.alerts.get()) if self.alerts.exists() else []
        acks = np.sort(np.array([x[0] for x in self.acks.get()] if self.acks.exists() else [], np.int64))
        due = [x for x in alerts if x[0] + self.wait <= now]
        times = np.array([x[0] for x in due], np.int64)
        following = np.append(acks, np.iinfo(np.int64).max)[np.searchsorted(acks, times)]
        late = following - self.wait > times
        yield pd.DataFrame({"alert_id": np.array([x[1] for x in due], object)[late], "fired_us": times[late]})
        left, recent = [x for x in alerts if x[0] + self.wait > now], acks[acks > now - self.wait]
        self.alerts.put(left) if left else self.alerts.clear()
        self.acks.put([(int(x),) for x in recent]) if len(recent) else self.acks.clear()
        if left or len(recent):
            self.timer.earliest(min([x[0] for x in left] + recent.tolist()) + self.wait)

    def close(self) -> None:
        pass


def escalate_stream(alerts: DataFrame, acks: DataFrame, delay_minutes: int = 30, ts: str = "timestamp", key: str = "zone_id", delay: str | None = DEFAULT_DELAY) -> DataFrame:
    """Critical alerts nobody acknowledged in time, as ``rules.escalate``: rows (key, rule, alert_id, timestamp, escalated_at).

    ``acks`` holds (key, rule, ack_time). No ``delay``: both streams have their watermarks already.
    """
    acks = acks.withColumnRenamed("ack_time", ts)
    fired, answered = (event_time(x, ts, delay) if delay else x for x in (alerts.filter("severity = 'critical'"), acks))
    fired = fired.select(key, "rule", ts, F.unix_micros(ts).alias("us"), F.col("alert_id").cast("string").alias("alert_id"))
    both = fired.unionByName(answered.select(key, "rule", ts, F.unix_micros(ts).alias("us"), F.lit(None).cast("string").alias("alert_id")))
    late = both.groupBy(key, "rule").transformWithStateInPandas(
        Escalation(delay_minutes), outputStructType="alert_id string, fired_us bigint", outputMode="Append", timeMode="EventTime"
    )
    at = F.timestamp_micros("fired_us")
    return late.select("alert_id", at.alias(ts), (at + F.expr(f"INTERVAL {int(delay_minutes)} MINUTE")).alias("escalated_at"))
