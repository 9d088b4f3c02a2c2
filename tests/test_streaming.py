import datetime as dt

from emberlog.streaming import live

T0 = dt.datetime(2026, 8, 5, 20, 0, 0)


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_growing_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\npart")
    (folder / "b.md").write_text("no\n")
    df, out = live.growing_files(spark, f"file://{folder}"), f"{tmp_path}/out"

    def run():
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["line_no"], r["line"]) for r in spark.read.parquet(out).collect())

    assert run() == [(1, "one"), (2, "two")]
    with (folder / "a.log").open("a") as f:
        f.write("ial\nfour\n")
    assert run() == [(1, "one"), (2, "two"), (3, "partial"), (4, "four")]
    (folder / "a.log").write_text("new\n")
    assert run() == [(1, "new"), (1, "one"), (2, "two"), (3, "partial"), (4, "four")]


def test_growing_files_are_cut_into_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    told = [f"{i} " + "x" * 90 for i in range(40_000)]
    (folder / "a.log").write_text("\n".join(told) + "\npart")
    spark.dataSource.register(live.GrowingFiles)
    df = spark.readStream.format("growing_files").option("path", f"file://{folder}").option("task_bytes", 1 << 19).load()
    out = f"{tmp_path}/out"

    def run():
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return [(r["line_no"], r["line"]) for r in spark.read.parquet(out).orderBy("line_no").collect()]

    assert run() == list(enumerate(told, 1))
    reader = live.GrowingFiles({"path": f"file://{folder}", "task_bytes": str(1 << 19)}).streamReader(None)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) > 2 and [p.start for p in parts[1:]] == [p.end for p in parts[:-1]] and reader.latestOffset() == reader.latestOffset()
    with (folder / "a.log").open("a") as f:
        f.write("ial\nlast\n")
    assert run() == list(enumerate([*told, "partial", "last"], 1))


def source(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")


def test_suppression(spark, tmp_path):
    rows = [("k", 2, T0 + dt.timedelta(minutes=m)) for m in range(5)] + [("l", 0, T0), ("l", 0, T0)]
    df = source(spark, tmp_path, "alerts", rows, "dedup_key string, dedup_window_minutes int, ts_utc timestamp")
    got = drain(live.suppress(df), "fired", tmp_path).orderBy("dedup_key", "ts_utc").collect()
    assert [(r["dedup_key"], r["ts_utc"].minute) for r in got] == [("k", 0), ("k", 2), ("k", 4), ("l", 0), ("l", 0)]


def test_transitions(spark, tmp_path):
    states = ["healthy", "down", "no_data", "healthy", "healthy", "down"]
    rows = [("v", T0 + dt.timedelta(minutes=m), s) for m, s in enumerate(states)]
    df = source(spark, tmp_path, "checks", rows, "service string, at timestamp, status string")
    got = drain(live.transitions(df), "changes", tmp_path).orderBy("at").collect()
    assert [(r["at"].minute, r["is_down"]) for r in got] == [(1, True), (3, False), (5, True)]


def test_notifier(spark, tmp_path):
    df = source(spark, tmp_path, "n", [("r", "k")], "rule string, dedup_key string")
    seen = []

    def notify(rows):
        seen.extend(rows)
        return ["sent"] * len(rows)

    live.to_notifier(df, notify, f"{tmp_path}/log", f"{tmp_path}/cn").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 1 and spark.read.parquet(f"{tmp_path}/log").first()["status"] == "sent"


def test_unanswered(spark, tmp_path):
    """Requests count as lost once their grace is over for the watermark, which a later event moves."""
    s = lambda n: T0 + dt.timedelta(seconds=n)
    first = [("a", s(0), "input"), ("a", s(2), "response"), ("b", s(1), "input"), ("c", s(3), "input"), ("c", s(20), "response"), ("z", s(100), "other"), ("z", s(90), "input"), ("z", s(91), "response")]
    df = source(spark, tmp_path, "asked", first, "correlation_id string, ts_utc timestamp, role string")
    got = drain(live.unanswered(df), "lost", tmp_path).orderBy("correlation_id").collect()
    assert [(r["correlation_id"], r["ts_utc"]) for r in got] == [("b", s(1)), ("c", s(3))]


def test_dispatches(spark, tmp_path):
    df = source(spark, tmp_path, "d", [(f"r{k}", "k") for k in range(5)], "rule string, dedup_key string")
    notify = live.simulated("[x] ")
    live.to_notifier(df, notify, f"{tmp_path}/log", f"{tmp_path}/cd", most=2).trigger(availableNow=True).start().awaitTermination()
    total, page = live.dispatches(spark, f"{tmp_path}/log", 1, 3)
    rows = page.collect()
    assert total == 5 and len(rows) == 3 and rows[0]["call"] == 2 and rows[0]["status"].startswith("simulated: [x] r")
    assert live.dispatches(spark, f"{tmp_path}/log", 2, 3)[1].count() == 2
