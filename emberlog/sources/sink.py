"""The event store as a streaming sink in two phases: "event_store".

Tasks write files of events under a name of their own attempt and report it; the batch's row, written by the driver in one step, names
the attempts that count, so events are read once or not at all. A repeated micro-batch finds the row of the first and leaves
it; the files of lost, failed or repeated attempts are never read, and are removed where the driver still hears of them.

Options: path (of the store, with a scheme), name (of the stream; its batches are called name-0, name-1, ...). Events come
with the columns of the store, but for event_id and batch_id, which follow from the stream, file (its path, where there is one) and line.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from emberlog.operators.schema import EVENT_COLUMNS


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its attempt, files and number of events."""

    attempt: str
    files: list[str] = field(default_factory=list)
    events: int = 0
    names: list[str] = field(default_factory=list)


def _remove(system, messages) -> None:
    for m in messages:
        for f in m.files if m else ():
            try:
                system.delete_file(f)
            except OSError:  # it is never read
                pass


class EventSink(DataSourceStreamArrowWriter):
    def __init__(self, uri: str, name: str, schema: StructType):
        self.uri, self.name, self.names = uri, name, schema.fieldNames()

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, batches: Iterator) -> Written:
        """One file for each source system and day that the task's events have."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, base = self._system()
        done = Written(uuid.uuid4().hex)
        files, seen = {}, set()
        try:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                day = pc.strftime(pc.fill_null(rows["ts_utc"], pa.scalar(0, rows.schema.field("ts_utc").type)), "%Y-%m-%d")
                rows = rows.append_column("attempt", pa.array([done.attempt] * len(rows), "string")).append_column("_day", day)
                seen.update(pc.unique(rows["file_name"]).to_pylist())
                for source in pc.unique(rows["source_system"]).to_pylist():
                    of_source = rows.filter(pc.is_null(rows["source_system"]) if source is None else pc.equal(rows["source_system"], source))
                    for d in pc.unique(of_source["_day"]).to_pylist():
                        part = of_source.filter(pc.equal(of_source["_day"], d)).drop_columns(["_day", "source_system"])
                        if (source, d) not in files:
                            value = "__HIVE_DEFAULT_PARTITION__" if not source else "".join(c if c.isalnum() or c in "-_. " else f"%{ord(c):02X}" for c in source)
                            folder = f"{base}/events/source_system={value}/event_date={d}"
                            system.create_dir(folder, recursive=True)
                            done.files.append(path := f"{folder}/part-{done.attempt}-{len(files)}.parquet")
                            files[source, d] = pq.ParquetWriter(path, part.schema, filesystem=system, compression="snappy")
                        files[source, d].write_table(part)
                done.events += len(rows)
        finally:
            for f in files.values():
                f.close()
        done.names = sorted(n for n in seen if n)
        return done

    def commit(self, messages: list, batchId: int) -> None:
        """The row appears by a rename, so it is there as a whole or not at all. A micro-batch without events has none."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, base = self._system()
        batch, good = f"{self.name}-{batchId}", [m for m in messages if m and m.events]
        if not good:
            return None
        system.create_dir(f"{base}/batches", recursive=True)
        path = f"{base}/batches/part-{batch}.parquet"
        if system.get_file_info(path).is_file:
            return _remove(system, good)
        names = sorted({n for m in good for n in m.names})
        row = {
            "batch_id": [batch],
            "file_name": [names[0] if len(names) == 1 else self.name],
            "file_size_bytes": pa.array([None], "int64"),
            "total_events": pa.array([sum(m.events for m in good)], "int64"),
            "matched_profile": pa.array([None], "string"),
            "match_ratio": pa.array([None], "float64"),
            "uploaded_at": pa.array([dt.datetime.now(dt.timezone.utc)], pa.timestamp("us", "UTC")),
            "attempts": pa.array([[m.attempt for m in good]], pa.list_(pa.string())),
        }
        hidden = f"{base}/batches/_{uuid.uuid4().hex}"
        pq.write_table(pa.table(row), hidden, filesystem=system)
        system.move(hidden, path)

    def abort(self, messages: list, batchId: int) -> None:
        _remove(self._system()[0], messages)


class EventStoreSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_store"

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventSink:
        return EventSink(self.options["path"], self.options.get("name", "stream"), schema)


def to_store(events: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """A writer of a stream of events (the store's columns but event_id and batch_id, all of them optional) into the store at path."""
    events.sparkSession.dataSource.register(EventStoreSink)
    file = "path" if "path" in events.columns else "file_name"
    ids = {"event_id": F.sha2(F.concat_ws(":", F.lit(name), file, "line_no"), 256), "batch_id": F.lit(name)}
    kinds = {"line_no": "int", "ts_utc": "timestamp"}
    rows = events.select(*[ids[c].alias(c) if c in ids else F.col(c) if c in events.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in EVENT_COLUMNS])
    return rows.writeStream.format("event_store").option("path", path).option("name", name).option("checkpointLocation", checkpoint)

