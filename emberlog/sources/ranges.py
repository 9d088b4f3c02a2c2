"""Log files anywhere that pyarrow opens, as a source cut into byte ranges: "log_files", for batches and streams.

A range takes the lines that begin in it, so ranges need no line counts and no byte is read to plan a batch. A stream's offsets are the bytes
of each file up to its last complete line, for which the driver reads the end of a file's new bytes, a block at a time until it meets a
line end. Filters on path and modified choose files before any is opened.

Options: path (a folder or file, with a scheme), extensions, range_bytes (of a task), and for streams trigger_bytes: what a file gives to a micro-batch
at most, unless a single line is longer. A file that can't be opened keeps its offset and is tried again with the next batch; others go on. A file that
shrank starts anew.
"""

from __future__ import annotations

import datetime as dt
import operator
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from emberlog.sources.files import EXTENSIONS

SCHEMA = "path string, file_name string, modified timestamp, block long, at long, line string"
#: Bytes read at once, and lines of a record batch.
BLOCK, LINES = 1 << 20, 8192


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from start up to end; opens: where a line is known to begin at or before start."""

    path: str
    modified: dt.datetime | None
    opens: int
    start: int
    end: int

    def __post_init__(self):
        super().__init__(self.path)


class Files:
    """Listing and reading, shared by batch and stream."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))
        self.range_bytes = int(options.get("range_bytes", 64 << 20))
        self.trigger_bytes = int(options.get("trigger_bytes", 1 << 40))

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def listed(self) -> list[tuple[str, int, dt.datetime | None]]:
        """path, size, modified of files with a known extension, by path."""
        from pyarrow import fs

        system, base = self.system()
        top = system.get_file_info(base)
        found = [top] if top.is_file else system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return sorted((f.path, f.size, f.mtime) for f in found if f.is_file and f.path.lower().endswith(self.extensions))

    def cut(self, path: str, modified: dt.datetime | None, start: int, end: int) -> list[Range]:
        places = [*range(start, end, self.range_bytes), end]
        return [Range(path, modified, start, a, b) for a, b in zip(places, places[1:])]

    def last_line_end(self, path: str, start: int, size: int) -> int:
        """Where the last complete line from start on ends, within trigger_bytes if one does; start if none is complete."""
        system, _ = self.system()
        stop = min(size, start + self.trigger_bytes)
        with system.open_input_file(path) as f:
            at = stop
            while at > start:
                begin = max(start, at - BLOCK)
                if (k := f.read_at(at - begin, begin).rfind(b"\n")) >= 0:
                    return begin + k + 1
                at = begin
            while stop < size:  # one line is longer than a trigger
                block = f.read_at(min(BLOCK, size - stop), stop)
                if (k := block.find(b"\n")) >= 0:
                    return stop + k + 1
                stop += len(block)
        return start

    def lines(self, part: Range) -> Iterator:
        """Record batches of the range's lines."""
        import pyarrow as pa

        system, _ = self.system()
        name = posixpath.basename(part.path)

        def batch(found: list[tuple[int, bytes]]):
            n = len(found)
            texts = [raw.removesuffix(b"\r").decode("utf-8", "replace") for _, raw in found]
            when = None if part.modified is None else part.modified.astimezone(dt.timezone.utc)
            cols = [pa.array([part.path] * n), pa.array([name] * n), pa.array([when] * n, pa.timestamp("us", "UTC")), pa.array([part.start] * n, "int64"), pa.array([a for a, _ in found], "int64"), pa.array(texts, "string")]
            return pa.RecordBatch.from_arrays(cols, ["path", "file_name", "modified", "block", "at", "line"])

        with system.open_input_file(part.path) as f:
            # A line that begins before start ends at or after start - 1; it belongs to the range before.
            at = part.start if part.start == part.opens else part.start - 1
            skipping, rest, found = at != part.start, b"", []
            while True:
                block = f.read_at(BLOCK, at + len(rest))
                *whole, rest = (rest + block).split(b"\n")
                for raw in whole:
                    if not skipping:
                        if at >= part.end:
                            break
                        found.append((at, raw))
                    skipping, at = False, at + len(raw) + 1
                if len(found) >= LINES:
                    yield batch(found)
                    found = []
                if at >= part.end or not block:
                    break
            if rest and not skipping and at < part.end:  # the last line of a file, without an end
                found.append((at, rest))
            if found:
                yield batch(found)


class _BatchReader(DataSourceReader):
    COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}

    def __init__(self, files: Files):
        self.files, self.kept = files, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else ()
            if name in (("path",), ("modified",)) and type(f) in (*self.COMPARED, In, StringStartsWith):
                self.kept.append(f)
            else:
                yield f

    def _takes(self, path: str, modified: dt.datetime | None) -> bool:
        for f in self.kept:
            value = path if f.attribute == ("path",) else modified
            if value is None:
                return False
            if isinstance(f, StringStartsWith):
                good = value.startswith(f.value)
            elif isinstance(f, In):
                good = any(value == self._like(x, value) for x in f.value)
            else:
                good = self.COMPARED[type(f)](value, self._like(f.value, value))
            if not good:
                return False
        return True

    @staticmethod
    def _like(given, value):
        """A time without a zone is meant in UTC, as the session's times are."""
        return given.replace(tzinfo=dt.timezone.utc) if isinstance(value, dt.datetime) and isinstance(given, dt.datetime) and given.tzinfo is None else given

    def partitions(self) -> list[Range]:
        found = [r for path, size, modified in self.files.listed() if self._takes(path, modified) for r in self.files.cut(path, modified, 0, size)]
        return found or [Range("", None, 0, 0, 0)]

    def read(self, part: Range) -> Iterator:
        if part.end:
            yield from self.files.lines(part)


class _StreamReader(DataSourceStreamReader):
    """Offsets: bytes taken of each file."""

    def __init__(self, files: Files):
        self.files, self.known, self.errors = files, {}, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # A file that is gone or can't be opened stays where it was.
        out, self.errors = dict(self.known), {}
        for path, size, _ in self.files.listed():
            start = self.known.get(path, 0)
            start = 0 if size < start else start
            try:
                out[path] = self.files.last_line_end(path, start, size) if size > start else start
            except OSError as e:
                self.errors[path] = str(e)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # After a restart the batch that Spark plans first tells what was taken before.
        self.known = {**end, **self.known}
        parts = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = 0 if stop < begin else begin
            parts += self.files.cut(path, None, begin, stop) if stop > begin else []
        return parts

    def read(self, part: Range) -> Iterator:
        yield from self.files.lines(part)

    def commit(self, end: dict) -> None:
        pass


class LogFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(Files(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(Files(self.options))


def log_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of files as a batch: path, file_name, modified, block, at (first byte of the line), line. Filters on path and modified choose files."""
    spark.dataSource.register(LogFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("log_files").options(path=path, **options).load()


def following(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as a stream, of complete lines alone; modified is null."""
    spark.dataSource.register(LogFiles)
    return spark.readStream.format("log_files").options(path=path, **options).load()


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Adds line_no to a batch's lines. Each range counts for itself; one row for each range carries the counts of those before."""
    inside = lines.withColumn("_k", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")))
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return inside.join(carried, ["path", "block"]).select(*lines.columns, (F.col("_before") + F.col("_k")).cast("int").alias("line_no"))
