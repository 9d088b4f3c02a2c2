import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ingest, profiles
from emberlog.sources.files import EventStore

NOW = dt.datetime(2026, 1, 1)


def at():
    return F.lit(NOW).cast("timestamp")


def test_ingest(spark, tmp_path):
    store, seen = EventStore(spark, f"{tmp_path}/store"), []
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2026-08-05T20:17:33Z", "level": "error", "service": "s", "message": "m"}\n' * 3)
    got = ingest.ingest(spark, store, f"{tmp_path}/a.jsonl", now=NOW, on_batch=lambda e: seen.append(e.count()))
    assert (got.events, got.parsed, got.matched, got.match_ratio, got.warnings, seen) == (3, 3, "Application JSON Log", 1.0, [], [3])
    (tmp_path / "b.log").write_text("8/5/2026 8:17:33 PM Log Tracker No: SU001 => Request Body {\"TransactionId\": \"X\"}\nbroken\n")
    got = ingest.ingest(spark, store, f"{tmp_path}/b.log", now=NOW)
    assert got.events == 2 and got.matched.startswith("AFS")
    (tmp_path / "c.log").write_text("nothing known\n")
    got = ingest.ingest(spark, store, f"{tmp_path}/c.log", now=NOW)
    assert got.matched == "Apache Access Log" and len(got.warnings) == 1 and got.events == 1
    (tmp_path / "d.log").write_text("")
    assert ingest.ingest(spark, store, f"{tmp_path}/d.log", now=NOW).batch_id is None
    assert store.batches().count() == 3 and store.events().count() == 6
    got = ingest.ingest(spark, store, f"{tmp_path}/a.jsonl", forced="application json log", now=NOW)
    assert got.match_ratio == 0.0
    with pytest.raises(KeyError):
        ingest.ingest(spark, store, f"{tmp_path}/a.jsonl", forced="no such", now=NOW)


def test_new_profiles(spark, lines):
    df = lines("\n".join(f"2026-08-05 20:17:{k:02d} | INFO | m{k}" for k in range(60)))
    good = profiles.Profile("pipes", "delimited", "|", delimiter_fields=("timestamp", "level", "message"))
    assert ingest.check_profile(good, df, at()) == []
    bad = profiles.Profile("bad", "regex", "(")
    assert ingest.check_profile(bad, df, at())[0].startswith("pattern")
    assert "no group" in ingest.check_profile(profiles.Profile("x", "regex", "(?P<a>.)"), df, at())[0]
    tries = iter([bad, good])
    assert ingest.generate_profile(df, at(), lambda text, wrong: next(tries)) == good
    with pytest.raises(ValueError):
        ingest.generate_profile(df, at(), lambda text, wrong: bad)
    got = [r["line_no"] for r in ingest.profile_sample(df, 3, 3, 2).collect()]
    assert got[:3] == [1, 2, 3] and got[-3:] == [58, 59, 60]


def test_polling(spark):
    listing = spark.createDataFrame([("same", 5, 1), ("grown", 9, 2), ("cut", 2, 2), ("new", 3, 1)], "path string, size long, modified long")
    known = spark.createDataFrame([("same", 5, 1, 5), ("grown", 5, 1, 5), ("cut", 5, 1, 5)], "path string, size long, modified long, bytes_read long")
    got = {r["path"]: (r["offset"], r["rotated"]) for r in ingest.changed(listing, known).collect()}
    assert got == {"grown": (5, False), "cut": (0, True), "new": (0, False)}
    rows = [("a", True, None, 5), ("b", True, NOW - dt.timedelta(minutes=6), 5), ("c", True, NOW, 5), ("d", False, None, 5)]
    sources = spark.createDataFrame(rows, "name string, enabled boolean, last_polled timestamp, interval_minutes int")
    assert [r["name"] for r in ingest.due(sources, at()).orderBy("name").collect()] == ["a", "b"]


def test_a_failed_attempt_leaves_nothing(spark, tmp_path, monkeypatch):
    """An attempt that ends between events and batch is never read, and a batch isn't stored twice."""
    store = EventStore(spark, f"{tmp_path}/store")
    schema = "file_name string, line_no int, ts_utc timestamp, ts_raw string, ts_confidence string, level string, source_system string, component string, message string, raw string, attributes string"
    rows = spark.createDataFrame([("a.log", k, NOW, "", "parsed" if k else "unparseable", "INFO", "s", "c", "m", "m", "{}") for k in range(3)], schema)

    def fail(self, row):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(EventStore, "_commit", fail)
        with pytest.raises(OSError, match="lost"):
            store.add(rows, "a.log", 1, None, 1.0, "b1", NOW)
    assert store.batches().count() == 0 and store.events().count() == 0
    for _ in range(2):
        store.add(rows, "a.log", 1, None, 1.0, "b1", NOW)
    assert store.events().count() == 3 == store.events("b1").select("event_id").distinct().count() and store.batches().first()["total_events"] == 3
    assert store.counts["b1"] == {"events": 3, "timed": 2} and store.events("b2").count() == 0


def test_directories(spark, tmp_path):
    folder, store = tmp_path / "in", EventStore(spark, f"{tmp_path}/store")
    (folder / "sub").mkdir(parents=True)
    line = '{"timestamp": "2026-08-05T20:17:33Z", "level": "error", "service": "s", "message": "m"}\n'
    (folder / "a.jsonl").write_text(line)
    (folder / "sub" / "b.LOG").write_text(line * 2)
    (folder / "big.log").write_text(line * 50)
    (folder / "c.md").write_text("no")
    got = ingest.ingest_directory(spark, store, str(folder), max_bytes=1000, forced="application json log", now=NOW)
    assert [s.events for s in got.ingested] == [1, 2] and len(got.errors) == 1 and "big.log" in got.errors[0] and [p.endswith("c.md") for p in got.skipped] == [True]
    with pytest.raises(ingest.FileTooLarge):
        ingest.ingest(spark, store, f"{folder}/big.log", max_bytes=10)
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.md").write_text("no")
        ingest.ingest_directory(spark, store, str(tmp_path / "none"))


def test_rows_of_any_width(spark, lines):
    """Without names every value has a column; with names a row of another width doesn't fit."""
    import json

    wide = profiles.Profile("wide", "delimited", ",", timestamp_field="col_0", message_field="col_1")
    text = "\n".join([",".join(["2026-08-05 20:17:33", *(str(k) for k in range(69))]), '2026-08-05 20:17:34,"a, ""b""",,x'])
    got = profiles.parse(profiles.records_of(lines(text), wide), wide, at()).orderBy("line_no").collect()
    first, second = (json.loads(r["attributes"]) for r in got)
    assert len(first) == 70 and first["col_69"] == "68"
    assert got[1]["message"] == 'a, "b"' and second["col_3"] == "x" and all(r["parsed"] for r in got)
    named = profiles.Profile("n", "delimited", ",", delimiter_fields=("timestamp", "message"))
    assert [r["parsed"] for r in profiles.parse(profiles.records_of(lines("2026-08-05 20:17:33,m\n2026-08-05 20:17:33,m,x"), named), named, at()).orderBy("line_no").collect()] == [True, False]
