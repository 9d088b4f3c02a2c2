"""Streams: hourly counts, suppression of repeated alerts, availability, and files that grow."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.functions.times import hour_label


#: What is logged of an attempt to notify.
LOG = "rule string, dedup_key string, status string, triggered_at timestamp"


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and level; an hour is final once the watermark has passed it."""
    return events.withWatermark("ts_utc", late).groupBy(F.window("ts_utc", "1 hour").alias("w"), "level").agg(F.count("*").alias("n")).select(hour_label(F.col("w.start")).alias("hour"), "level", "n")


def suppress(alerts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Alerts (dedup_key, dedup_window_minutes, ts_utc, ...) that fire, by event time within a key.

    State of a key: when it last fired. Rows of a micro-batch are taken in time; suppressed ones don't prolong the window.
    Once the watermark has passed a key's window its state goes, as nothing that may still come would be suppressed by it.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts_utc", kind="stable")
        keep = []
        for t, w in zip(rows["ts_utc"], rows["dedup_window_minutes"]):
            micros = int(t.value // 1000)
            keep.append(last is None or micros - last >= w * 60_000_000)
            last = micros if keep[-1] else last
        state.update((last,))
        over = last // 1000 + 60_000 * int(rows["dedup_window_minutes"].max()) + 1
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    return alerts.withWatermark("ts_utc", late).groupBy("dedup_key").applyInPandasWithState(fold, alerts.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def unanswered(events: DataFrame, grace_ms: int = 5000, late: str = "10 seconds") -> DataFrame:
    """correlation_id, ts_utc of each request that had no response within its grace, once the watermark has passed it.

    events: correlation_id, ts_utc, role (input or response). State of a transaction: its open requests. A response
    closes those at or before it that it still reaches in time.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ms, seen = (list(x) for x in state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for rows in batches:
                for t, role in zip(rows["ts_utc"], rows["role"]):
                    (open_ms if role == "input" else seen).append(int(t.value // 1_000_000))
        now = state.getCurrentWatermarkMs()
        open_ms, seen = sorted(open_ms), sorted(seen)
        first = [bisect_left(seen, a) for a in open_ms]
        open_ms = [a for a, k in zip(open_ms, first) if k == len(seen) or seen[k] > a + grace_ms]
        lost = [a for a in open_ms if a + grace_ms < now]
        open_ms = [a for a in open_ms if a + grace_ms >= now]
        seen = [b for b in seen if b >= now - grace_ms]
        if open_ms or seen:
            state.update((open_ms, seen))
            state.setTimeoutTimestamp(max(min(open_ms + seen) + grace_ms + 1, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"correlation_id": [key[0]] * len(lost), "ts_utc": pd.to_datetime(lost, unit="ms")})

    rows = events.select("correlation_id", "ts_utc", "role").where("role IN ('input', 'response') AND ts_utc IS NOT NULL").withWatermark("ts_utc", late)
    return rows.groupBy("correlation_id").applyInPandasWithState(walk, "correlation_id string, ts_utc timestamp", "waiting array<long>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def every(spark: SparkSession, seconds: int, check: Callable[[SparkSession], None], checkpoint: str):
    """A query that runs a check at a fixed interval, never two at once: a check that takes longer delays the next."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: check(batch.sparkSession))


def poll(sources: dict[str, tuple[DataFrame, int]], write: Callable[[str], Callable[[DataFrame, int], None]], folder: str) -> dict:
    """Starts a query for each source by its own interval in minutes; sources don't wait for each other. Returns the queries by name."""
    started = {}
    for name, (lines, minutes) in sources.items():
        query = lines.writeStream.foreachBatch(write(name)).option("checkpointLocation", f"{folder}/{name}").trigger(processingTime=f"{minutes} minutes")
        started[name] = query.queryName(name).start()
    return started


def transitions(checks: DataFrame) -> DataFrame:
    """service, at, is_down for each change among checks (service, at, status); no_data counts as down, the first up isn't a change."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        down = bool(state.get[0]) if state.exists else False
        rows, out = pd.concat(list(batches)).sort_values("at", kind="stable"), []
        for at, status in zip(rows["at"], rows["status"]):
            now = status in ("down", "no_data")
            if now != down:
                out.append((key[0], at, now))
                down = now
        state.update((down,))
        yield pd.DataFrame(out, columns=["service", "at", "is_down"])

    return checks.groupBy("service").applyInPandasWithState(walk, "service string, at timestamp, is_down boolean", "down boolean", "append", GroupStateTimeout.NoTimeout)


def to_notifier(alerts: DataFrame, notify: Callable[[list[dict]], list[str]], log_path: str, checkpoint: str, most: int = 1000):
    """A query that hands alerts to a notifier, `most` rows a call, and logs every attempt under its batch and call.

    A repeated batch overwrites its log. The driver holds the rows of one call.
    """

    def send(batch: DataFrame, number: int) -> None:
        def call(k: int, part: list[dict]) -> None:
            at = dt.datetime.now(dt.timezone.utc)
            rows = [(str(a.get("rule")), str(a.get("dedup_key")), status, at) for a, status in zip(part, notify(part))]
            batch.sparkSession.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").parquet(f"{log_path}/batch={number}/call={k}")

        part: list[dict] = []
        calls = 0
        for row in batch.toLocalIterator():
            part.append(row.asDict())
            if len(part) >= most:
                call(calls, part)
                part, calls = [], calls + 1
        if part:
            call(calls, part)

    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def dispatches(spark: SparkSession, log_path: str, page: int = 1, size: int = 50) -> tuple[int, DataFrame]:
    """How many attempts there were, and a page of them, newest first."""
    rows = spark.read.schema(f"{LOG}, batch long, call int").parquet(log_path)
    newest = rows.orderBy(F.desc("triggered_at"), F.desc("batch"), F.desc("call"), "rule", "dedup_key")
    return rows.count(), newest.offset((page - 1) * size).limit(size)


def simulated(prefix: str = "", send: Callable[[str, dict], str] | None = None) -> Callable[[list[dict]], list[str]]:
    """A notifier: a subject with the prefix for each alert. Without a way to send, every attempt counts as a simulated success."""

    def notify(alerts: list[dict]) -> list[str]:
        subjects = [f"{prefix}{a.get('rule')}: {str(a.get('message') or '')[:100]}" for a in alerts]
        return [send(s, a) if send else f"simulated: {s}" for s, a in zip(subjects, alerts)]

    return notify


class _Tail(InputPartition):
    def __init__(self, path: str, start: int, end: int, first_line: int):
        self.path, self.start, self.end, self.first_line = path, start, end, first_line


class _GrowingReader(DataSourceStreamReader):
    """Offsets: for each file how many bytes and lines were read, and where new ones can be cut into tasks.

    What shrank starts anew; a line without an end waits.
    """

    def __init__(self, folder: str, extensions: tuple[str, ...], task_bytes: int):
        self.folder, self.extensions, self.task_bytes = folder, extensions, task_bytes

    def _files(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.folder)
        for f in sorted(system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)), key=lambda x: x.path):
            if f.is_file and f.path.lower().endswith(self.extensions):
                yield system, f.path, f.size

    def _ends(self, system, path: str, start: int, first: int, size: int) -> tuple[int, int, list[tuple[int, int]]]:
        """Bytes up to the last complete line, how many lines they hold, and cuts between lines on the way; read in blocks."""
        end, lines, at, cuts = start, first, start, [(start, first)]
        with system.open_input_file(path) as f:
            while at < size:
                block = f.read_at(min(1 << 20, size - at), at)
                if (last := block.rfind(b"\n")) >= 0:
                    end, lines = at + last + 1, lines + block.count(b"\n")
                    if end - cuts[-1][0] >= self.task_bytes:
                        cuts.append((end, lines))
                at += len(block)
        return end, lines, cuts[1:]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known = getattr(self, "_known", {})
        out = {}
        for system, path, size in self._files():
            start, first, _ = known.get(path, (0, 0, []))
            if size < start:
                start, first = 0, 0
            end, lines, cuts = self._ends(system, path, start, first, size)
            # An offset that says the same in other words would start an empty batch.
            out[path] = known[path] if path in known and end == known[path][0] else [end, lines, cuts]
        self._known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[_Tail]:
        parts = []
        for path, (stop, _, cuts) in end.items():
            begin, first, *_ = start.get(path, (0, 0))
            if stop < begin:
                begin, first = 0, 0
            if stop > begin:
                opened = [(begin, first), *[(at, lines) for at, lines in cuts if begin < at < stop]]
                closed = [at for at, _ in opened[1:]] + [stop]
                parts += [_Tail(path, at, until, lines + 1) for (at, lines), until in zip(opened, closed)]
        return parts

    def read(self, part: _Tail):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(part.path) as f:
            rest, at, number = b"", part.start, part.first_line
            while at < part.end:
                block = rest + f.read_at(min(1 << 20, part.end - at), at)
                at = min(at + (1 << 20), part.end)
                *whole, rest = block.split(b"\n")
                for line in whole:
                    yield (part.path.rsplit("/", 1)[-1], number, line.rstrip(b"\r").decode("utf-8", "replace"))
                    number += 1

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """Stream source "growing_files": numbered lines of files below a folder, as they are written.

    Options: path, extensions, and task_bytes, beyond which what is new in a file goes to several tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "file_name string, line_no int, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        extensions = tuple(self.options.get("extensions", ".log,.txt,.jsonl,.csv,.tsv").split(","))
        return _GrowingReader(self.options["path"], extensions, int(self.options.get("task_bytes", 64 << 20)))


def growing_files(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", folder).load()
