"""Files as byte ranges, records across micro-batches, the two-phase sink, and availability by timers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from emberlog.operators.grouping import group_lines, opens_record
from emberlog.operators.profiles import Profile
from emberlog.sources import ranges, sink
from emberlog.sources.files import EventStore
from emberlog.streaming import follow, records, watch

TEXT = "".join(f"2026-08-05 20:00:{k:02d},000 [main] ERROR core - début {k}\n  at line {k}\n\n  and more\n" for k in range(6))
PROFILE = Profile("core", "regex", r"^(?P<timestamp>\d{4}-\d{2}-\d{2} [\d:,]+) \[[^\]]*\] (?P<level>\w+) (?P<component>\w+) - (?P<message>.*)$")


def wait(query, done, seconds=90):
    """Until done() holds; an error of the query ends it."""
    began = time.time()
    while time.time() - began < seconds:
        if query.exception():
            raise query.exception()
        if done():
            return
        time.sleep(0.3)
    raise AssertionError("not in time")


# Ranges


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
@pytest.mark.parametrize("text", [TEXT, TEXT + "no end", "", "\n\n\n", "one", "a\r\nb\r\n"])
def test_ranges_take_each_line_once(tmp_path, size, text):
    (tmp_path / "a.log").write_bytes(text.encode())
    (tmp_path / "b.bin").write_text("not read\n")
    files = ranges.Files({"path": f"file://{tmp_path}", "range_bytes": str(size)})
    ((path, n, modified),) = files.listed()
    found = [(a, t) for part in files.cut(path, modified, 0, n) for b in files.lines(part) for a, t in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
    want, at = [], 0
    for raw in text.encode().splitlines(keepends=True) if "\r" not in text else [b"a\r\n", b"b\r\n"]:
        want.append((at, raw.rstrip(b"\r\n").decode()))
        at += len(raw)
    assert found == want


def test_ranges_as_a_batch(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.log").write_text(TEXT)
    (tmp_path / "x" / "b.txt").write_text("one\ntwo")
    df = ranges.log_files(spark, f"file://{tmp_path}", range_bytes=50)
    got = [(r["line_no"], r["line"]) for r in ranges.with_line_numbers(df).where("file_name = 'a.log'").orderBy("line_no").collect()]
    assert got == list(enumerate(TEXT.split("\n")[:-1], 1))
    # Filters choose files before they are opened: a file that can't be read isn't missed.
    (tmp_path / "x" / "b.txt").unlink()
    (tmp_path / "x" / "b.txt").symlink_to(tmp_path / "x")
    one = df.where(F.col("path") == f"{tmp_path}/a.log")
    assert one.count() == len(got) and df.where("path LIKE '/nowhere%'").count() == 0
    assert df.where("modified < '2001-01-01'").count() == 0 and df.where("modified > '2001-01-01' AND file_name = 'a.log'").count() == len(got)


def test_offsets_are_bytes_of_complete_lines(tmp_path):
    a = tmp_path / "a.log"
    a.write_text("one\ntwo\npart")
    reader = ranges._StreamReader(ranges.Files({"path": f"file://{tmp_path}", "trigger_bytes": "5"}))
    assert reader.latestOffset() == {str(a): 4} and reader.latestOffset() == {str(a): 8} and reader.latestOffset() == {str(a): 8}
    with a.open("a") as f:
        f.write(" of a line that is longer than a trigger\n")
    assert reader.latestOffset() == {str(a): a.stat().st_size}
    a.write_text("new\n")
    assert reader.latestOffset() == {str(a): 4} and [(p.start, p.end) for p in reader.partitions({str(a): 50}, {str(a): 4})] == [(0, 4)]


def test_a_file_that_cannot_be_opened_waits(tmp_path, monkeypatch):
    for n in ("a.log", "b.log"):
        (tmp_path / n).write_text("one\n")
    reader = ranges._StreamReader(ranges.Files({"path": f"file://{tmp_path}"}))
    real = ranges.Files.last_line_end

    def failing(self, path, *more):
        if path.endswith("a.log"):
            raise OSError("no permission")
        return real(self, path, *more)

    monkeypatch.setattr(ranges.Files, "last_line_end", failing)
    assert reader.latestOffset() == {f"{tmp_path}/b.log": 4} and list(reader.errors) == [f"{tmp_path}/a.log"]
    monkeypatch.setattr(ranges.Files, "last_line_end", real)
    assert reader.latestOffset() == {f"{tmp_path}/a.log": 4, f"{tmp_path}/b.log": 4} and not reader.errors


# Records


class Handle:
    """State of a processor in a test, as the engine keeps it."""

    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return State()

    def getValueState(self, *_):
        return State()

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if not isinstance(self.value, list) else iter(self.value)

    def put(self, x):
        self.value = list(x)

    def update(self, x):
        self.value = x

    def appendList(self, x):
        self.value = (self.value or []) + list(x)

    def clear(self):
        self.value = None


class Clock:
    def __init__(self, now=0):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def split_lines(text, start):
    """Lines of text from byte start on that are complete, with their places, and where they end."""
    import re

    rows, at = [], start
    for raw in text.encode()[start:].splitlines(keepends=True):
        if raw.endswith(b"\n"):
            line = raw[:-1].decode()
            rows.append(("p", "a.log", at, line, bool(re.match(r"^\d{4}-", line)), not line.strip()))
            at += len(raw)
    return rows, at


def test_a_record_cut_anywhere_is_whole(spark, lines):
    import pandas as pd

    want = sorted((r["line_no"], r["header"], r["continuation"], r["raw"]) for r in group_lines(lines(TEXT), opens_record(F.col("line"))).collect())
    names, raw = ["path", "file_name", "at", "line", "starts", "blank"], TEXT.encode()
    for cut in range(len(raw) + 1):
        walk, handle = records.OpenRecords(1000), Handle()
        walk.init(handle)
        got, begin = [], 0
        for end in (cut, len(raw)):
            part, begin = split_lines(raw[:end].decode("utf-8", "ignore"), begin)
            if part:
                # Rows come in any order and in several batches.
                frames = [pd.DataFrame(part[k::2], columns=names) for k in (1, 0) if part[k::2]]
                got += [x for f in walk.handleInputRows(("p",), iter(frames), Clock(5)) for x in f.itertuples(index=False)]
                assert handle.timers == ([1005] if walk.lines.exists() else [])
        got += [x for f in walk.handleExpiredTimer(("p",), Clock(), Clock(1005)) for x in f.itertuples(index=False)]
        assert sorted((x.line_no, x.header, x.continuation, x.raw) for x in got) == want
        assert not [x for f in walk.handleExpiredTimer(("p",), Clock(), Clock(1005)) for x in f.itertuples(index=False)]


# Sink


def stored(spark, path):
    return sorted((r["batch_id"], r["line_no"], r["message"]) for r in EventStore(spark, path).events().collect())


def test_each_event_once_when_a_batch_fails_between_write_and_commit(spark, tmp_path):
    path, schema = f"file://{tmp_path}/store", "file_name string, line_no int, ts_utc timestamp, source_system string, message string"
    at = dt.datetime(2026, 8, 5, 20, 0)
    rows = [("a.log", k, None if k == 3 else at + dt.timedelta(hours=k * 7), "core" if k % 2 else None, f"m{k}") for k in range(6)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    broken = tmp_path / "store" / "batches"
    broken.parent.mkdir()
    broken.write_text("a file where a folder must be")  # tasks can write, the commit can't
    with pytest.raises(Exception):
        sink.to_store(events, path, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    broken.unlink()
    sink.to_store(events, path, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = stored(spark, path)
    assert [x[1:] for x in sorted(got, key=lambda x: x[1])] == [(k, f"m{k}") for k in range(6)] and {x[0] for x in got} <= {"stream-0", "stream-1", "stream-2"}
    days = {r["line_no"]: r["event_date"] for r in EventStore(spark, path).events().collect()}
    assert days[3] == dt.date(1970, 1, 1) and days[5] == dt.date(2026, 8, 7)
    assert sum(r["total_events"] for r in EventStore(spark, path).batches().collect()) == 6
    # The same batch again, as after a crash between commit and checkpoint: its row is left as it is, and its files go.
    writer = sink.EventSink(path, "stream", events.schema)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"file_name": "a.log", "line_no": 0, "ts_utc": at, "source_system": "core", "message": "again"}])
    message = writer.write(iter([batch]))
    files = len(list((tmp_path / "store" / "events").rglob("*.parquet")))
    writer.commit([message, None], 0)
    assert len(list((tmp_path / "store" / "events").rglob("*.parquet"))) == files - 1 and stored(spark, path) == got
    message = writer.write(iter([batch]))
    writer.abort([message, None], 9)
    assert stored(spark, path) == got and writer.write(iter([])).events == 0


def test_events_from_growing_files_reach_the_store_and_the_rules(spark, tmp_path):
    folder, store = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    raw = TEXT.encode()
    (folder / "a.log").write_bytes(raw[:150])
    seen = []

    def rules(events, batch):
        seen.append((batch, events.where("level = 'ERROR'").count()))

    def start():
        return follow.follow(spark, f"file://{folder}", store, PROFILE, f"{tmp_path}/c", rules, idle_seconds=25, seconds=0.2)

    running = start()
    wait(running.store, lambda: any(p["numInputRows"] for p in running.store.recentProgress))
    running.stop()
    with (folder / "a.log").open("ab") as f:
        f.write(raw[150:])
    running = start()
    wait(running.store, lambda: sum({b: n for b, n in seen}.values()) >= 6)
    running.stop()
    found = EventStore(spark, store).events().orderBy("line_no").collect()
    assert [r["line_no"] for r in found] == [1, 5, 9, 13, 17, 21] and len({r["event_id"] for r in found}) == 6
    assert all(r["level"] == "ERROR" and r["raw"].count("\n") == 2 for r in found)
    assert sum({b: n for b, n in seen}.values()) == 6


# Availability


def test_silence_is_one_alert():
    import pandas as pd

    walk, handle = watch.Availability(600_000), Handle()
    walk.init(handle)
    t0 = pd.Timestamp("2026-08-05 20:00")
    ms = int(t0.value // 1_000_000)

    def checks(*rows, now=0):
        frame = pd.DataFrame([(t0 + pd.Timedelta(minutes=m), s) for m, s in rows], columns=["at", "status"])
        return [tuple(x)[1:4] for f in walk.handleInputRows(("v",), iter([frame]), Clock(ms + now * 60_000)) for x in f.itertuples(index=False)]

    def silence(minute):
        return [tuple(x)[1:4] for f in walk.handleExpiredTimer(("v",), Clock(), Clock(ms + minute * 60_000)) for x in f.itertuples(index=False)]

    assert checks((0, "healthy"), now=1) == [] and handle.timers == [ms + 660_000]
    assert checks((5, "healthy"), now=6) == [] and handle.timers == [ms + 960_000]
    assert silence(16) == [(t0 + pd.Timedelta(minutes=16), True, "no_data")]
    assert silence(30) == [] and walk.state.get() == (True, ms + 16 * 60_000, ms + 30 * 60_000)
    back = [x for f in walk.handleInputRows(("v",), iter([pd.DataFrame({"at": [t0 + pd.Timedelta(minutes=40)], "status": ["healthy"]})]), Clock(ms)) for x in f.itertuples(index=False)]
    assert [(x.is_down, x.down_minutes) for x in back] == [(False, 24.0)]
    assert checks((41, "down"), (43, "down"), (44, "no_data"), (42, "healthy")) == [(t0 + pd.Timedelta(minutes=41), True, "down"), (t0 + pd.Timedelta(minutes=42), False, "healthy"), (t0 + pd.Timedelta(minutes=43), True, "down")]


def test_silence_in_a_running_stream(spark, tmp_path):
    t0 = dt.datetime(2026, 8, 5, 20, 0)
    spark.createDataFrame([("v", t0, "healthy"), ("w", t0, "down"), (None, t0, "down")], "service string, at timestamp, status string").coalesce(1).write.parquet(f"{tmp_path}/in")
    checks = spark.readStream.schema("service string, at timestamp, status string").parquet(f"{tmp_path}/in")
    out, state = f"{tmp_path}/out", f"{tmp_path}/c"

    def start():
        return watch.availability(checks, silence_minutes=1 / 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()

    def changes():
        try:
            return sorted((r["service"], r["is_down"], r["reason"]) for r in spark.read.schema(watch.CHANGE).parquet(out).collect())
        except Exception:
            return []

    want = [("v", True, "no_data"), ("w", True, "down")]
    query = start()
    wait(query, lambda: changes() == want)
    query.stop()
    query = start()  # what was told is known after a restart
    n = len(query.recentProgress)
    wait(query, lambda: len(query.recentProgress) > n + 3)
    query.stop()
    assert changes() == want
    found = {r["service"]: (r["is_down"], r["down_since"]) for r in watch.current(spark, state).collect()}
    assert found["v"][0] and found["w"] == (True, t0)
