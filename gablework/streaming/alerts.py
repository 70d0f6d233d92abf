"""Alert states on a stream of metric samples, by rules with hold times from a table.

A rule is judged at every sample of its metrics, in the order of event time: samples wait in the state until the
watermark has passed them, for which a timer is set. So rows that come late within the watermark, or twice after a
replay, change nothing, and the episodes equal those of ``monitor.alert_episodes`` over the same samples.

The state of a rule and an instance is bounded by the samples of its window and of the watermark's delay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixed

RULE_COLUMNS = ["alert", "severity", "measure", "metric", "other", "comparator", "threshold", "window", "hold"]
RULE_DDL = (
    "alert string, severity string, measure string, metric string, other string, comparator string, threshold double, "
    "window double, hold double"
)
EPISODE_DDL = (
    "alert string, severity string, instance string, since double, fired_at double, last_ts double, samples long, ended boolean"
)


def alert_rules(spark: SparkSession) -> DataFrame:
    """The catalogue of alerts: what is measured, its limit, its window and how long it must hold."""
    return spark.createDataFrame(fixed.ALERT_RULES, RULE_DDL)


def increase(series: list[tuple[int, float]], at: int, window: int) -> float | None:
    """Growth between the samples of the window, resets counted from zero; None for fewer than two."""
    inside = [value for us, value in series if at - window <= us <= at]
    if len(inside) < 2:
        return None
    return sum(b if b < a else b - a for a, b in zip(inside, inside[1:]))


def measured(rule: dict, past: dict[str, list[tuple[int, float]]], at: int, now: dict[str, float]) -> float | None:
    """What the rule measures at this moment, from the samples of its metrics up to it."""
    kind, metric, other = rule["measure"], rule["metric"], rule["other"]
    if kind == "value":
        return now.get(metric)
    if kind == "age":
        return None if now.get(metric) is None else at / 1e6 - now[metric]
    span, window = int(rule["window"] * 1e6), rule["window"]
    grown = {name: increase(past.get(name, []), at, span) for name in (metric, other) if name in now}
    own, second = grown.get(metric), grown.get(other)
    if kind == "increase":
        return own
    if own is None:
        return None
    rate = own / window
    if kind == "rate":
        return rate
    if kind == "share":  # of the other rate, which counts as 1 at least
        return rate / max(1.0 if second is None else second / window, 1.0)
    return rate / (second / window) if second else None  # mean


def breached(value: float | None, comparator: str, threshold: float) -> bool:
    if value is None or math.isnan(value):
        return False
    return value > threshold if comparator == ">" else value < threshold if comparator == "<" else value == threshold


class Run:
    """The unbroken run in which a rule's condition holds, and the episode that it fires after its hold time."""

    def __init__(self, since: float | None = None, fired: float | None = None, last: float | None = None, samples: int = 0):
        self.since, self.fired, self.last, self.samples = since, fired, last, samples

    def judge(self, at: float, holds: bool, hold: float) -> tuple | None:
        """Takes one moment; returns the episode that ends with it."""
        ended = None
        if not holds:
            ended = self.episode() if self.fired is not None else None
            self.__init__()
            return ended
        if self.since is None:
            self.since = at
        if at - self.since >= hold:
            self.fired = at if self.fired is None else self.fired
            self.last, self.samples = at, self.samples + 1
        return None

    def episode(self) -> tuple:
        return self.since, self.fired, self.last, self.samples


class AlertStates(StatefulProcessor):
    """Per alert and instance: samples that wait for the watermark, those of the window, and the open run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        series = "us array<bigint>, name array<string>, value array<double>"
        self.waiting = handle.getValueState("waiting", series)
        self.past = handle.getValueState("past", series)
        self.run = handle.getValueState("run", "since double, fired double, last double, samples bigint, done bigint")
        self.rule = handle.getValueState("rule", RULE_DDL)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.read(self.waiting)
        done = self.run.get()[4] if self.run.exists() else None
        known = {(us, name) for us, name, _ in held}
        for batch in rows:
            if not self.rule.exists() and len(batch):
                first = batch.iloc[0]
                self.rule.update(tuple(None if pd.isna(first[c]) else first[c] for c in RULE_COLUMNS))
            for us, name, value in zip(batch["us"].tolist(), batch["name"].tolist(), batch["value"].tolist()):
                if (us, name) not in known and (done is None or us > done):
                    known.add((us, name))
                    held.append((us, name, value))
        yield from self.advance(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, self.read(self.waiting), timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def read(state: Any) -> list[tuple[int, str, float]]:
        return list(zip(*state.get())) if state.exists() else []

    @staticmethod
    def write(state: Any, samples: list[tuple[int, str, float]]) -> None:
        state.update(tuple(list(c) for c in zip(*samples)) if samples else ([], [], []))

    def advance(self, key: Any, held: list[tuple[int, str, float]], watermark: int) -> Iterator[pd.DataFrame]:
        """Judges all that the watermark has passed; the rest waits for the next timer."""
        rule = dict(zip(RULE_COLUMNS, self.rule.get()))
        held.sort()
        due = [s for s in held if s[0] <= watermark * 1000]
        rest = held[len(due) :]
        self.write(self.waiting, rest)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        if not due:
            return
        *fields, done = self.run.get() if self.run.exists() else (None, None, None, 0, 0)
        run, span = Run(*fields), int((rule["window"] or 0.0) * 1e6)
        past: dict[str, list[tuple[int, float]]] = {}
        for us, name, value in self.read(self.past):
            past.setdefault(name, []).append((us, value))
        out = []
        k = 0
        while k < len(due):
            at, now = due[k][0], {}
            while k < len(due) and due[k][0] == at:
                now[due[k][1]] = due[k][2]
                past.setdefault(due[k][1], []).append((at, due[k][2]))
                k += 1
            past = {name: [p for p in series if p[0] >= at - span] for name, series in past.items()}
            holds = breached(measured(rule, past, at, now), rule["comparator"], rule["threshold"])
            ended = run.judge(at / 1e6, holds, rule["hold"])
            if ended:
                out.append((*ended, True))
        if run.fired is not None:
            out.append((*run.episode(), False))
        self.write(self.past, [(us, name, value) for name, series in past.items() for us, value in series])
        self.run.update((run.since, run.fired, run.last, run.samples, due[-1][0]))
        if out:
            rows = [(rule["alert"], rule["severity"], key[1], *row) for row in out]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EPISODE_DDL.split(", ")])


def alert_stream(samples: DataFrame, rules: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Episodes of firing alerts as they grow and end, out of a stream of samples (ts seconds, instance, name, value).

    Rows of one episode replace each other by (alert, instance, since); ``episodes`` gives the last ones. Needs the
    RocksDB state store. Samples older than the watermark are not judged.
    """
    metrics = F.explode(F.array_compact(F.array_distinct(F.array("metric", "other"))))
    wanted = rules.withColumn("name", metrics)  # two rows per rule at most
    us = F.round(F.col("ts") * 1e6).cast("bigint")
    timed = samples.select(us.alias("us"), "instance", "name", "value", F.timestamp_micros(us).alias("event_time"))
    joined = timed.withWatermark("event_time", late).join(F.broadcast(wanted), "name")
    return joined.groupBy("alert", "instance").transformWithStateInPandas(
        AlertStates(), outputStructType=EPISODE_DDL, outputMode="Update", timeMode="EventTime"
    )


def episodes(updates: DataFrame) -> DataFrame:
    """The episodes out of all updates of a stream, whatever was replayed: (alert, severity, instance, since,
    fired_at, last_ts, samples)."""
    return updates.groupBy("alert", "severity", "instance", "since").agg(
        F.min("fired_at").alias("fired_at"), F.max("last_ts").alias("last_ts"), F.max("samples").alias("samples")
    )
