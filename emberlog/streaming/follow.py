"""From files that grow to stored events and alerts: source, records, profile, sink and rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators import profiles
from emberlog.operators.profiles import Profile
from emberlog.sources.files import EventStore
from emberlog.sources.ranges import following
from emberlog.sources.sink import to_store
from emberlog.streaming.records import group_stream


@dataclass
class Followed:
    """The queries of one followed folder: files into the store, and the store's new batches to the rules."""

    store: StreamingQuery
    rules: StreamingQuery | None

    def stop(self) -> None:
        for q in (self.store, self.rules):
            if q:
                q.stop()


def events_of(lines: DataFrame, profile: Profile, ingested: Column | None = None, idle_seconds: float = 60) -> DataFrame:
    """Canonical events, with path, of a stream of lines (sources.ranges.following)."""
    records = group_stream(lines, profiles.start_of(profile), idle_seconds)
    return profiles.parse(records, profile, F.current_timestamp() if ingested is None else ingested, keep=("path",))


def follow(spark: SparkSession, folder: str, store: str, profile: Profile, checkpoint: str, rules: Callable[[DataFrame, str], None] | None = None, name: str = "stream", idle_seconds: float = 60, seconds: float = 10, **options) -> Followed:
    """Starts to take what is written below folder into the store, each event once, whatever fails on the way.

    rules gets the events of each stored batch and its name, in the order of batches, at least once; an alert's key makes repeats harmless
    (streaming.live.suppress). A file that can't be opened is tried again with each batch, and doesn't stop the others.
    """
    events = events_of(following(spark, folder, **options), profile, idle_seconds=idle_seconds)
    taken = to_store(events, store, f"{checkpoint}/store", name).trigger(processingTime=f"{seconds} seconds").start()
    return Followed(taken, watch_batches(spark, store, rules, f"{checkpoint}/rules", seconds) if rules else None)


def watch_batches(spark: SparkSession, store: str, rules: Callable[[DataFrame, str], None], checkpoint: str, seconds: float = 10) -> StreamingQuery:
    """Gives the events of each batch that is committed to a store to the rules, by the stream of its batch rows."""
    kept = EventStore(spark, store)
    spark.createDataFrame([], EventStore.COMMITS).write.mode("append").parquet(kept.batches_path)  # the folder must be there

    def evaluate(batch: DataFrame, number: int) -> None:
        # A row for each batch of events; those of one trigger are few.
        for row in batch.select("batch_id", "uploaded_at").distinct().orderBy("uploaded_at", "batch_id").toLocalIterator():
            rules(kept.events(row["batch_id"]), row["batch_id"])

    rows = spark.readStream.schema(EventStore.COMMITS).parquet(kept.batches_path)
    return rows.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
