"""Text files as numbered lines, directory scans, and the event store."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.schema import BATCH_SCHEMA, EVENT_COLUMNS, EVENT_SCHEMA

#: Extensions that are read, in any case.
EXTENSIONS = (".log", ".txt", ".jsonl", ".csv", ".tsv")
MAX_BYTES = 500 << 20
#: Ids that the Bloom filter of a row group is made for.
ROW_GROUP_IDS = 100_000
#: Attempts of a batch that a filter names; of more the join alone decides.
FILTERED_ATTEMPTS = 256
#: Lines of a block of blockwise() where the lines come from elsewhere than a file.
BLOCK_LINES = 1 << 14


def read_lines(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """file_name, path, block, line_no, line of text files of any size.

    Files are split as usual; a line's number is its place in its split plus the lines of the splits before, of which
    there is one count for each split. Only "\\n" ends a line; a "\\r" before it is dropped; bytes that are no UTF-8
    are replaced.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(list(paths))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("_at"))
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy("path", "block").orderBy("_at")))
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("_n"))
    before = counts.select("path", "block", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(before, ["path", "block"]).select("file_name", "path", "block", (F.col("_before") + F.col("_k")).cast("int").alias("line_no"), "line")


def blockwise(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """Adds a running count of flag over the lines of a file, without putting a file into one task.

    Each block counts for itself; the sums of the blocks before are one row for each block.
    """
    rows = lines if "block" in lines.columns else lines.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    rows = rows.withColumn("_flag", flag.cast("long"))
    sums = rows.groupBy("file_name", "block").agg(F.sum("_flag").alias("_sum"))
    before = sums.select("file_name", "block", F.coalesce(F.sum("_sum").over(Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_own", F.sum("_flag").over(Window.partitionBy("file_name", "block").orderBy("line_no")))
    return inside.join(before, ["file_name", "block"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_flag", "_own", "_before")


def scan_directory(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size, modified and verdict of each file: read, skipped (another extension) or too large. In order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    known = F.lit(False)
    for e in EXTENSIONS:
        known = known | F.endswith(F.lower("path"), F.lit(e))
    return files.withColumn("verdict", F.when(~known, "skipped").when(F.col("size") > max_bytes, "too large").otherwise("read")).orderBy("path")


class EventStore:
    """Events and batches as Parquet; events by source and day, so that filters prune folders.

    Each attempt to store a batch has a name of its own, in its events and in the batch row, which is written after them and
    is the commit: events of other attempts are never read. A batch that is stored already isn't stored again. A batch of a stream
    (sources.sink) has an attempt for each of its tasks.
    """

    STORED = f"{EVENT_SCHEMA}, attempt string, event_date date"
    COMMITS = f"{BATCH_SCHEMA}, attempts array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.events_path, self.batches_path = spark, f"{path}/events", f"{path}/batches"
        self.counts: dict[str, dict[str, int]] = {}

    def add(self, events: DataFrame, file_name: str, size: int, profile: str | None, ratio: float, batch_id: str | None = None, at: dt.datetime | None = None) -> str:
        """Stores a batch of events; event ids follow from batch and line, so a repeated attempt makes the same ones.

        The numbers of events, and of those whose time is known, are counted by the write itself (see `counts`).
        """
        batch_id, attempt = batch_id or uuid.uuid4().hex, uuid.uuid4().hex
        if not self._commits().where(F.col("batch_id") == batch_id).isEmpty():
            return batch_id
        seen = Observation()
        rows = events.withColumn("batch_id", F.lit(batch_id)).withColumn("event_id", F.sha2(F.concat_ws(":", F.lit(batch_id), "file_name", "line_no"), 256))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("events"), F.count_if(F.col("ts_confidence") != "unparseable").alias("timed"))
        day = F.coalesce(F.to_date("ts_utc"), F.lit("1970-01-01").cast("date")).alias("event_date")
        # Ids are digests, so only a Bloom filter tells a look-up which row groups to read.
        writer = rows.select(*EVENT_COLUMNS, F.lit(attempt).alias("attempt"), day).write.mode("append").option("parquet.bloom.filter.enabled#event_id", "true").option("parquet.bloom.filter.expected.ndv#event_id", str(ROW_GROUP_IDS))
        writer.partitionBy("source_system", "event_date").parquet(self.events_path)
        self.counts[batch_id] = seen.get
        self._commit((batch_id, file_name, size, seen.get["events"], profile, round(ratio, 3), at or dt.datetime.now(dt.timezone.utc), [attempt]))
        return batch_id

    def _commit(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.COMMITS).coalesce(1).write.mode("append").parquet(self.batches_path)

    def _commits(self) -> DataFrame:
        """One row for each batch: of two attempts that both committed the first counts."""
        try:
            rows = self.spark.read.schema(self.COMMITS).parquet(self.batches_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.COMMITS)
        names = [c for c in rows.columns if c != "batch_id"]
        return rows.groupBy("batch_id").agg(F.min_by(F.struct(*names), F.struct("uploaded_at", "attempts")).alias("x")).select("batch_id", "x.*")

    def events(self, batch_id: str | None = None, without: Sequence[str] = ()) -> DataFrame:
        """The events of all batches, or of one; those of the files `without` aren't read (see sources.textindex)."""
        stored, commits = self.spark.read.schema(self.STORED).parquet(self.events_path), self._commits()
        if without:
            stored = stored.where(~F.col("_metadata.file_path").isin(list(without)))
        if batch_id is not None:
            commits = commits.where(F.col("batch_id") == batch_id)
            attempts = [x for r in commits.select("attempts").collect() for x in r["attempts"]]
            if len(attempts) <= FILTERED_ATTEMPTS:  # files are chosen by their statistics
                stored = stored.where(F.col("attempt").isin(attempts))
        named = commits.select(F.col("batch_id").alias("_batch"), F.explode("attempts").alias("attempt"))
        found = stored.join(named, "attempt")
        return found.select(*[F.col("_batch").alias(c) if c == "batch_id" else F.col(c) for c in stored.columns if c != "attempt"])

    def batches(self) -> DataFrame:
        """All batches, newest first."""
        return self._commits().drop("attempts").orderBy(F.desc("uploaded_at"), "batch_id")

    def clear(self) -> None:
        """Leaves an empty store."""
        self.spark.createDataFrame([], self.STORED).write.mode("overwrite").partitionBy("source_system", "event_date").parquet(self.events_path)
        self.spark.createDataFrame([], self.COMMITS).write.mode("overwrite").parquet(self.batches_path)


def write_json(records: DataFrame, path: str) -> None:
    """A parser's records as JSON lines, in as many files as there are partitions."""
    records.write.mode("overwrite").json(path)


def write_csv(features: DataFrame, path: str) -> None:
    """A flat table, such as the minutes' features with their scores, as CSV with a header."""
    features.write.mode("overwrite").option("header", True).csv(path)


def rollup(batches: DataFrame) -> DataFrame:
    """Number of files and events, bytes, and the mean match ratio."""
    return batches.agg(F.count("*").alias("files"), F.coalesce(F.sum("total_events"), F.lit(0)).alias("events"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"), F.avg("match_ratio").alias("match_ratio"))
