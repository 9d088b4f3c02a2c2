"""Availability of services from a stream of checks or activity: silence is noticed by timers, not by rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberlog.streaming.records import with_timers

CHANGE = "service string, at timestamp, is_down boolean, reason string, down_minutes double"
NAMES = ["service", "at", "is_down", "reason", "down_minutes"]
#: Statuses that count as down, and the minutes without any check that count as no_data.
DOWN = ("down", "no_data")
GAP_MINUTES = 10


class Availability(StatefulProcessor):
    """State of a service: whether it is down, since when, and its last check. A timer that no check has moved says no_data.

    Only changes come out: the first up isn't one; what is down already isn't told again; recovery tells how long it was down.
    """

    def __init__(self, silence_ms: int, keep_ms: int | None = None):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("availability", "is_down boolean, down_since long, last_check long", self.keep_ms)

    def _changed(self, service: str, at: int, status: str, out: list) -> None:
        down, since, last = self.state.get() if self.state.exists() else (False, None, None)
        now = status in DOWN
        if now and not down:
            out.append((service, pd.Timestamp(at, unit="ms"), True, status, None))
            since = at
        elif down and not now:
            out.append((service, pd.Timestamp(at, unit="ms"), False, status, round((at - since) / 60_000, 1)))
            since = None
        self.state.update((now, since, at if last is None else max(at, last)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        for at, status in sorted((int(t.value // 1_000_000), s) for r in rows for t, s in zip(r["at"], r["status"])):
            self._changed(key[0], at, status, out)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        self._changed(key[0], expiredTimerInfo.getExpiryTimeInMs(), "no_data", out)
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def availability(checks: DataFrame, silence_minutes: float = GAP_MINUTES, keep_days: float | None = None) -> DataFrame:
    """Changes of services from a stream of checks (service, at, status): service, at, is_down, reason (the status), down_minutes on recovery.

    A service from which no check came for silence_minutes of processing time is down by no_data, once, until its next check. With
    keep_days the state of a service goes that long after its last check.
    """
    with_timers(checks.sparkSession)
    keep = int(keep_days * 86_400_000) if keep_days else None
    rows = checks.select("service", "at", "status").where("service IS NOT NULL AND at IS NOT NULL")
    return rows.groupBy("service").transformWithStateInPandas(Availability(int(silence_minutes * 60_000), keep), CHANGE, "append", "ProcessingTime")


def activity(events: DataFrame) -> DataFrame:
    """A check that says healthy for each event: services are then watched by their events alone."""
    return events.select(F.col("source_system").alias("service"), F.col("ts_utc").alias("at"), F.lit("healthy").alias("status"))


def current(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """service, is_down, down_since, last_check (times) as of the last batch of a stopped or running query, read from its checkpoint."""
    reader = spark.read.format("statestore").option("stateVarName", "availability")
    with_timers(spark)
    state = (reader.option("batchId", batch) if batch is not None else reader).load(checkpoint)
    when = [F.timestamp_millis(F.col(f"value.{c}")).alias(c) for c in ("down_since", "last_check")]
    return state.select("key.service", "value.is_down", *when)
