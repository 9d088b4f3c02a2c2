"""Records over a stream of lines: the open record of a file waits in state for its next line, across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RECORD = "path string, file_name string, line_no int, header string, continuation array<string>, raw string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Processors with list state and timers need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class OpenRecords(StatefulProcessor):
    """State of a file: the lines of its open record, how many lines it has had, and the byte of its last one.

    A header closes the record before it; a file without new lines for idle_ms closes its own by a timer, and what comes
    later is a record of its own. A file that starts anew begins with line 1.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "file_name string, line_no int, line string")
        self.seen = handle.getValueState("seen", "lines int, at long")

    @staticmethod
    def record(path: str, lines: list[tuple]) -> tuple:
        texts = [t for _, _, t in lines]
        return (path, lines[0][0], lines[0][1], texts[0], texts[1:], "\n".join(texts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # What a file gives to a micro-batch is bounded by the source (trigger_bytes).
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        number, last = self.seen.get() if self.seen.exists() else (0, -1)
        opened = [tuple(x) for x in self.lines.get()] if self.lines.exists() else []
        kept, closed = len(opened), []
        if int(batch["at"].iloc[0]) <= last:
            if opened:
                closed.append(self.record(key[0], opened))
            opened, kept, number = [], 0, 0
        for name, line, starts, blank in zip(batch["file_name"], batch["line"], batch["starts"], batch["blank"]):
            number += 1
            if blank:
                continue
            if starts and opened:
                closed.append(self.record(key[0], opened))
                opened, kept = [], 0
            opened.append((name, number, line))
        self.seen.update((number, int(batch["at"].iloc[-1])))
        if closed or not kept:
            self.lines.put(opened) if opened else self.lines.clear()
        elif len(opened) > kept:  # the record goes on: its lines so far stay as they are
            self.lines.appendList(opened[kept:])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        if opened:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(closed, columns=["path", "file_name", "line_no", "header", "continuation", "raw"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened = [tuple(x) for x in self.lines.get()] if self.lines.exists() else []
        self.lines.clear()
        yield pd.DataFrame([self.record(key[0], opened)] if opened else [], columns=["path", "file_name", "line_no", "header", "continuation", "raw"])

    def close(self) -> None:
        pass


def group_stream(lines: DataFrame, start: Column, idle_seconds: float = 60) -> DataFrame:
    """Records (as operators.grouping.group_lines makes them of a batch, with the file's path) of a stream of lines with path, file_name, at, line.

    start: true where a line opens a record, an expression over the lines. Blank lines are counted and left out. A record comes out when the next one
    opens, or when its file had no new line for idle_seconds.
    """
    with_timers(lines.sparkSession)
    rows = lines.select("path", "file_name", "at", "line", F.coalesce(start, F.lit(False)).alias("starts"), (F.trim("line", F.lit(" \t\r\n\x0b\f")) == "").alias("blank"))
    return rows.groupBy("path").transformWithStateInPandas(OpenRecords(int(idle_seconds * 1000)), RECORD, "append", "ProcessingTime")
