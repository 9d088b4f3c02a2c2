"""Scalars, grouping, profiles, correlation, alerts and reports on small hand-made inputs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import levels, payloads, text, times
from emberlog.operators import alerts, browse, correlate, grouping, profiles, reports, summaries
from emberlog.plans import adhoc
from emberlog.sources import files

T0 = dt.datetime(2026, 8, 5, 20, 0, 0)


def ingested():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")



def one(spark, expr, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "level"), [("debug", "DEBUG"), (" Warning ", "WARN"), ("ERR", "ERROR"), ("FATAL", "CRITICAL"), ("200", "INFO"), ("xx-fail-1", "ERROR"), ("what", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN")])
def test_levels(spark, raw, level):
    assert one(spark, levels.normalize_level(F.col("a"), {"200": "INFO"}), a=raw) == level


def test_thresholds(spark):
    reach = lambda a, b: one(spark, levels.reaches(F.col("a"), F.col("b")), a=a, b=b)
    assert reach("ERROR", "ERROR") and reach("CRITICAL", "WARN") and not reach("INFO", "WARN")
    assert not reach("UNKNOWN", "DEBUG") and reach("UNKNOWN", "UNKNOWN")


@pytest.mark.parametrize(
    ("raw", "zone", "ts", "confidence"),
    [
        ("2026-08-05T20:17:33Z", "UTC", "2026-08-05 20:17:33", "parsed"),
        ("2026-08-05 20:17:33.500 +02:00", None, "2026-08-05 18:17:33", "parsed"),
        ("05/Aug/2026:20:17:33 +0000", "UTC", "2026-08-05 20:17:33", "parsed"),
        ("8/5/2026  8:17:33 PM", "Europe/Berlin", "2026-08-05 18:17:33", "parsed"),
        ("Aug  5 20:17:33", None, "2026-08-05 20:17:33", "assumed_utc"),
        ("Wed Aug 05 20:17:33 2026", "UTC", "2026-08-05 20:17:33", "parsed"),
        ("junk", "UTC", "2026-01-01 00:00:00", "unparseable"),
        (None, "UTC", "2026-01-01 00:00:00", "unparseable"),
    ],
)
def test_times(spark, raw, zone, ts, confidence):
    got = one(spark, times.parse_time(F.col("a"), ingested(), zone), a=raw)
    assert (str(got["ts"]), got["confidence"]) == (ts, confidence)


def test_strptime_and_lenient_times(spark):
    assert one(spark, times.parse_time(F.col("a"), ingested(), "UTC", "%d.%m.%Y %H:%M:%S"), a="05.08.2026 20:17:33")["confidence"] == "parsed"
    assert str(one(spark, times.parse_time(F.col("a"), ingested(), "UTC", lenient=True), a="on 5 August 2026 at 20:17")["ts"]) == "2026-08-05 20:17:00"


def test_texts(spark):
    assert one(spark, text.mask(F.col("a")), a="4111222233334444") == "4111********4444" and one(spark, text.mask(F.col("a")), a="short") == "*****"
    assert one(spark, text.unescape_entities(F.col("a")), a="&lt;a&gt; &amp;lt;") == "<a> &lt;"
    assert one(spark, text.repair_ampersands(F.col("a")), a="A & B &amp; C") == "A &amp; B &amp; C"
    assert one(spark, text.parameters(F.col("a")), a="a=1, b = two words ,a=3") == {"b": "two words", "a": "3"}
    assert one(spark, text.loose_pairs(F.col("a")), a="a=1 2 b=x") == {"a": "1 2", "b": "x"}
    assert one(spark, text.base64_text(F.col("a")), a="aGVsbG8") == "hello" and one(spark, text.base64_text(F.col("a")), a="no base64!") is None
    got = one(spark, text.otp_message(F.col("a")), a="Dear Customer, 123456 is your OTP for card XXXX1234 at Big Shop for QAR 12.50.")
    assert (got["otp"], got["masked_card"], got["merchant"], got["currency"], got["amount"]) == ("123456", "XXXX1234", "Big Shop", "QAR", 12.5)
    assert one(spark, text.observables(F.col("a")), a="x@y.com 10.0.0.1 x@y.com")["emails"] == ["x@y.com"]


def test_all_references_of_html(spark):
    import html

    for s in ["&#34;&#x22;&#X22;&#10;", "&eacute;&copy;&middot;&copy=1", "&amp;lt; &amp;amp;", "&lt &notit; &nosuch; & &#;", "&#128;&#0;&#xD800;", "", "{&quot;a&quot;: &#39;b&#39;}"]:
        assert one(spark, text.unescape_all(F.col("a")), a=s) == html.unescape(s)
    assert one(spark, text.unescape_all(F.col("a")), a=None) is None and one(spark, text.unescape_all(F.col("a")), a="a&nbsp;b&#160;c") == "a b c"
    assert one(spark, text.tag(F.col("a"), "x"), a="<x>Caf&eacute; &#38;</x>") == "Café &"


def test_payloads(spark):
    got = one(spark, payloads.payload(F.col("a")), a='x {"A": {"b": "}"}, "C": [{"Type": "SMS", "Text": "+49"}]} y {"D": 1')
    assert [o["status"] for o in got["objects"]] == ["parsed", "incomplete"] and got["status"] == "incomplete"
    assert got["fields"]["b"] == "}" and got["fields"]["@mobile"] == "+49" and got["fields"]["d"] == "1"
    assert one(spark, payloads.payload(F.col("a")), a=None)["objects"] == []
    assert one(spark, payloads.unescape_html(F.col("a")), a="&eacute;") == "é"


def test_grouping_over_blocks(spark, lines):
    df = lines("lead\n2026-08-05 20:17:33 a\n\tframe\n\n2026-08-05 20:17:34 b").withColumn("block", F.floor(F.col("line_no") / 2))
    got = grouping.group_lines(df, grouping.opens_record(F.col("line"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["header"][-1], len(r["continuation"])) for r in got] == [(1, "d", 0), (2, "a", 1), (5, "b", 0)]
    assert got[1]["raw"] == "2026-08-05 20:17:33 a\n\tframe"
    chunked = grouping.group_lines(df, grouping.opens_record(F.col("line")), chunk=2)
    assert chunked.count() == 4


PROFILE = {p.name: p for p in profiles.DEFAULTS}


@pytest.mark.parametrize(
    ("name", "content", "level", "component", "source"),
    [
        ("Apache Access Log", '10.0.0.1 - - [05/Aug/2026:20:17:33 +0000] "GET /x HTTP/1.1" 503 12', "ERROR", "GET", "apache"),
        ("Standard Syslog", "Aug  5 20:17:33 host1 sshd[42]: accepted", "UNKNOWN", "sshd", "host1"),
        ("Application JSON Log", '{"timestamp": "2026-08-05T20:17:33Z", "level": "warn", "service": "s1", "message": "m"}', "WARN", "s1", "app_backend"),
        ("Delimited CSV/TSV Log", '2026-08-05 20:17:33,ERROR,core,"a, b"', "ERROR", "core", "csv_export"),
        ("Apache Error Log", "[Wed Aug 05 20:17:33.123456 2026] [core:error] [pid 1:tid 2] [client 1.2.3.4] boom", "ERROR", None, "1.2.3.4"),
        ("Spring Boot / Java Microservice Log", "2026-08-05 20:17:33.123  WARN 7 --- [main] a.b.C : hello", "WARN", "a.b.C", "springboot_app"),
        ("Standard Bracket [TIMESTAMP] [LEVEL]", "[2026-08-05 20:17:33] [INFO] [web] hi", "INFO", "web", "generic_app"),
    ],
)
def test_profiles(spark, lines, name, content, level, component, source):
    df = lines(f"{content}\n{content}")
    got = profiles.parse(profiles.records_of(df, PROFILE[name]), PROFILE[name], ingested()).orderBy("line_no").collect()
    assert len(got) == 2 and all(r["parsed"] for r in got)
    assert (got[0]["level"], got[0]["component"], got[0]["source_system"]) == (level, component, source)
    assert str(got[0]["ts_utc"]) == "2026-08-05 20:17:33"
    # A bracketed line fits the Apache error profile as well, which comes first.
    assert profiles.best_profile(df, profiles.DEFAULTS, ingested())[0].name in (name, "Apache Error Log")


def test_unparsed_lines_stay(lines):
    p = PROFILE["Application JSON Log"]
    got = profiles.parse(profiles.records_of(lines("not json"), p), p, ingested()).first()
    assert not got["parsed"] and got["message"] == "not json" and got["ts_confidence"] == "unparseable" and got["attributes"] == "{}"
    assert profiles.best_profile(lines("not json"), profiles.DEFAULTS, ingested()) == (None, 0.0)


def test_profile_folder(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    found, warnings = profiles.load_profiles(str(tmp_path))
    assert len(found) == len(profiles.DEFAULTS) and len(warnings) == 1
    assert profiles.profile_named(found, "standard syslog").default_source_system == "syslog"
    with pytest.raises(FileExistsError):
        profiles.save_profile(str(tmp_path), found[0], replace=False)


def events(spark, *rows):
    """(id, seconds, component, correlation, level, details)"""
    made = []
    for i, s, c, k, *rest in rows:
        level, details = (*rest, "INFO", {})[0], (rest[1] if len(rest) > 1 else {})
        made.append((str(i), "f", i, T0 + dt.timedelta(seconds=s), level, "src", c, f"message {c}", json.dumps({"correlation_id": k, "details": details}), k))
    return spark.createDataFrame(made, "event_id string, file_name string, line_no int, ts_utc timestamp, level string, source_system string, component string, message string, attributes string, correlation_id string")


def test_availability(spark):
    now = T0 + dt.timedelta(hours=1)
    assert reports.availability(events(spark, (1, 0, "sms_input", "a")), now=now)["status"] == "no_data"
    got = reports.availability(events(spark, (1, 0, "vplus_input", "a"), (2, 0, "vplus_response", "a"), (3, 10, "vplus_input", "b"), (4, 20, "vplus_response", "b")), now=now)
    assert (got["status"], got["responded"], got["delayed"]) == ("healthy", 2, 1)
    got = reports.availability(events(spark, (1, 0, "vplus_input", "a"), (2, 60, "vplus_input", "b"), (3, 120, "vplus_input", "c"), (4, 121, "vplus_response", "c")), now=now)
    assert got["status"] == "healthy" and got["downtime_windows"][0]["unresponded_count"] == 2 and got["downtime_windows"][0]["duration_minutes"] == 2.0
    got = reports.availability(events(spark, (1, 0, "vplus_input", "a")), now=now)
    assert got["status"] == "down" and got["unresponded"] == 1 and got["worst_unresponded"][0]["correlation_id"] == "a"
    grace = reports.availability(events(spark, (1, 0, "vplus_input", "a")), now=T0 + dt.timedelta(seconds=2))
    assert grace["status"] == "healthy" and grace["unresponded"] == 0
    future = reports.availability(events(spark, (1, 60, "vplus_input", "a")), now=T0)
    assert future["unresponded"] == 0
    lone = reports.availability(events(spark, (1, 0, "netcetera_response", "a")), now=now)
    assert lone["status"] == "healthy" and lone["inputs"] == 0
    gap = reports.availability(events(spark, (1, 0, "vplus_input", "a"), (2, 3600, "vplus_input", "b")), now=now + dt.timedelta(hours=2))
    assert len(gap["downtime_windows"]) == 2 and gap["downtime_windows"][0]["recovered_at"] is None


def test_response_times_and_flows(spark):
    e = events(spark, (1, 0, "vplus_input", "a"), (2, 3, "vplus_response", "a"), (3, 5, "vplus_response", "b"), (4, 9, "vplus_input", "b"), (5, 0, "sms_input", "a"), (6, 40, "sms_queue", "a"), (7, 50, "otp_success", "a"), (8, 0, "sms_input", "c"))
    got = reports.response_times(e)
    assert (got["pairs"], got["avg_ms"], got["delayed_pct"]) == (1, 3000.0, 100.0)
    assert reports.response_times(events(spark, (3, 5, "vplus_response", "b"), (4, 9, "vplus_input", "b")))["status"] == "no_data"
    sms = reports.sms_flows(e)
    assert sms["outcome_counts"] == {"otp_confirmed": 1, "queue_failed": 1} and sms["queue_delay_stats"]["delayed_pct"] == 50.0
    assert reports.sms_flows(events(spark, (1, 0, "vplus_input", "a")))["status"] == "no_data"


def test_investigation(spark):
    tx = {"transaction": {"issuer_id": "I", "merchant": {"name": "Shop"}, "otp_processed": True}}
    e = events(spark, (1, 0, "vplus_input", "a", "ERROR", tx), (2, 1, "error", "a", "ERROR", tx), (3, 2, "error", "b", "ERROR"))
    vplus = reports.availability(e, now=T0 + dt.timedelta(hours=1))
    got = reports.investigation(e, vplus, reports.response_times(e), reports.sms_flows(e))
    assert got["total_errors"] == 3 and got["findings"][0]["severity"] == "critical" and got["merchants"] == {"Shop": 2}
    assert got["findings"][-1]["severity"] == "low"
    assert [tuple(r) for r in reports.transactions(e).collect()] == [("a", "I", "OTP_PROCESSED")]


def test_summaries(spark):
    flow = {"flow": {"issuer_id": "I", "bank_org": "B", "authentication": {"status": "SUCCESS"}, "merchant": {"name": "M"}, "otp_processed": True, "oob": {"status_history": ["PENDING", "DONE"]}, "integrity_status": "CHECK"}}
    e = events(spark, (1, 0, "x", "a", "INFO", flow), (2, 1, "y", "a", "ERROR", flow | {"warnings": ["w1"]}), (3, 2, None, "b"))
    got = summaries.summary(e, "cardinal")
    assert got["entities"] == 1 and got["by"]["status"] == {"SUCCESS": 1} and got["by"]["check"] == {"true": 1} and got["oob"] == {"PENDING": 1, "DONE": 1}
    assert got["failed"]["count"] == 1 and got["failed"]["reasons"] == {"w1": 1} and got["event_types"]["unknown"] == 1
    assert summaries.summary(e.limit(0), "otp")["status"] == "no_data"
    assert summaries.summary(e, "otp")["success_rate"] is None


def test_aliases(spark):
    rows = spark.createDataFrame([("f", 1, ["tx:1", "t:a"]), ("f", 2, ["s:9", "t:b"]), ("f", 3, ["t:b", "t:a"]), ("f", 4, ["t:a"]), ("f", 5, []), ("g", 1, ["t:a"])], "batch_id string, ordinal int, aliases array<string>")
    got = {(r[0], r[1]): r[2] for r in correlate.resolve_aliases(rows).collect()}
    assert got == {("f", 1): "tx:1", ("f", 2): "s:9", ("f", 3): "s:9", ("f", 4): "s:9", ("f", 5): None, ("g", 1): "t:a"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_aliases_by_components_equal_the_walk_over_a_file(spark, seed):
    rng = random.Random(seed)
    rows = [("f", k, rng.choices([f"a{x}" for x in range(120)] + [None, ""], k=rng.randrange(0, 4))) for k in range(150)]
    known, want = {}, {}
    for _, k, aliases in rows:
        given = [a for a in aliases if a]
        want[k] = next((known[a] for a in given if a in known), given[0] if given else None)
        known |= dict.fromkeys(given, want[k])
    df = spark.createDataFrame(rows, "batch_id string, ordinal int, aliases array<string>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        found = correlate.resolve_aliases(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["ordinal"]: r["flow"] for r in found} == want and len({r["task"] for r in found}) > 1


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    from emberlog.operators.graphs import components

    rng = random.Random(5)
    edges = {"chain": [(k + 1, k) for k in range(40)], "star": [(7, k) for k in range(40)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "none": [(1, 1), (None, 2)]}[shape]
    root = {x: x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == root


def test_alerts(spark):
    e = events(spark, *[(i, 60 * i, "core", "a", "ERROR") for i in range(5)]).withColumn("batch_id", F.lit("b")).withColumn("message", F.lit("same"))
    rules = alerts.rules_frame(spark, [alerts.Rule("now", dedup_window_minutes=2), alerts.Rule("off", component_filter="zzz"), alerts.Rule("sum", mode="digest")])
    fired = alerts.suppress(alerts.immediate(alerts.matches(e, rules))).orderBy("ts_utc").collect()
    assert [r["event_id"] for r in fired] == ["0", "2", "4"]
    digest = alerts.digests(alerts.matches(e, rules)).collect()
    assert len(digest) == 1 and digest[0]["n"] == 5 and len(digest[0]["lines"]) == 5
    always = alerts.rules_frame(spark, [alerts.Rule("all", dedup_window_minutes=0)])
    assert alerts.suppress(alerts.immediate(alerts.matches(e, always))).count() == 5
    for bad in ({"rule": " "}, {"rule": "x", "min_level": "LOUD"}, {"rule": "x", "mode": "later"}):
        with pytest.raises(ValueError):
            alerts.Rule(**bad)


@pytest.mark.parametrize("sql", ["DELETE FROM e", "DROP TABLE e", "SELECT 1; SELECT 2", "INSERT INTO e SELECT 1", "", "SET x = 1"])
def test_guard_refuses(spark, sql):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.read_only(spark, sql)


def test_guard_runs(spark):
    assert adhoc.run(spark, "SELECT 'drop table' AS x").first()["x"] == "drop table"
    assert adhoc.run(spark, "SELECT * FROM range(1000) LIMIT 50000").count() == 500
    assert adhoc.run(spark, "```sql\nWITH a AS (SELECT id FROM range(3) LIMIT 2) SELECT * FROM a;\n```").count() == 2


def test_search_patterns(spark):
    e = events(spark, (1, 0, "a%b", "x"), (2, 0, "a\\b", "x"), (3, 0, "axb", "x"))
    ids = lambda **k: sorted(r["event_id"] for r in browse.matching(e, **k).collect())
    assert ids(search="A%B") == ["1", "2", "3"] and ids(search="a%b", literal=True) == ["1"] and ids(search="a\\b") == ["2"]
    assert ids(level="ALL") == ["1", "2", "3"] and ids(since=T0 + dt.timedelta(seconds=1)) == []
    with pytest.raises(ValueError):
        browse.page(e, 1, 6000)
    assert browse.resolve_range(T0, 2) == (T0 - dt.timedelta(hours=2), T0)
    assert browse.error_ratio(e.limit(0)).first()["error_ratio"] == 0.0


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_bytes(b"one\r\ntwo\xff\n\nlone\rcr\n")
    (tmp_path / "in/b.md").write_text("x")
    got = files.read_lines(spark, f"{tmp_path}/in/a.log").orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "one"), (2, "two�"), (3, ""), (4, "lone\rcr")]
    assert [r["verdict"] for r in files.scan_directory(spark, f"file://{tmp_path}/in").collect()] == ["read", "skipped"]
    store = files.EventStore(spark, f"{tmp_path}/store")
    p = PROFILE["Standard Bracket [TIMESTAMP] [LEVEL]"]
    lines = spark.createDataFrame([("a.log", 1, "[2026-08-05 20:17:33] [INFO] hi")], "file_name string, line_no int, line string")
    parsed = profiles.parse(profiles.records_of(lines, p), p, ingested())
    store.add(parsed, "a.log", 10, p.name, 1.0, "b1", T0)
    assert store.events().count() == 1 and store.batches().first()["total_events"] == 1
    assert files.rollup(store.batches()).first()["files"] == 1
    store.clear()
    assert store.events().count() == 0


def test_summaries_cap_merchants_alone(spark):
    rows = [(json.dumps({"issuer_id": f"i{k}", "merchant": {"name": f"m{k}"}}),) for k in range(20)]
    found = spark.createDataFrame(rows, "entity string")
    got = summaries.by_dimension(found, "debit", 15).groupBy("dimension").count().collect()
    assert {r["dimension"]: r["count"] for r in got if r["dimension"] in ("issuer", "merchant")} == {"issuer": 20, "merchant": 15}


@pytest.mark.parametrize(
    "sql",
    ["SELECT * FROM text.`/etc/hostname`", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'nanoTime')", "SELECT * FROM other", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "WITH a AS (SELECT * FROM parquet.`/x`) SELECT * FROM a", "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM events",
        "SELECT 'CTE [secret]' AS x, pw FROM secret",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS pw) SELECT * FROM secret) JOIN (SELECT pw FROM secret)",
        "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1) SELECT * FROM a",
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM IDENTIFIER('secret')",
        "SELECT id, sum(id) OVER w FROM events WINDOW w AS (ORDER BY (SELECT max(pw) FROM secret))",
        "SELECT * FROM events, LATERAL (SELECT pw FROM secret)",
        "SELECT * FROM events PIVOT (max(id) FOR id IN (1)) UNION SELECT pw FROM spark_catalog.default.secret",
    ],
)
def test_guard_walks_the_whole_plan(spark, sql):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.read_only(spark, sql, ["events"])


def test_guard_lets_queries_pass(spark):
    for sql in (
        "WITH a AS (SELECT id FROM events), b AS (SELECT id FROM A) SELECT * FROM b WHERE id IN (SELECT id FROM a)",
        "SELECT * FROM (WITH a AS (SELECT id FROM events) SELECT * FROM a) JOIN (WITH a AS (SELECT 1 AS k) SELECT * FROM a)",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
        "SELECT id, sum(id) OVER w FROM events WINDOW w AS (ORDER BY id)",
        "SELECT 'UnresolvedRelation [secret]' AS x FROM events, LATERAL explode(array(1, 2))",
    ):
        assert adhoc.read_only(spark, sql, ["events"]) == sql
    view = spark.range(5).withColumn("text", F.lit("reflect( java_method"))
    many = ", ".join(f"id + {k} AS c{k}" for k in range(60))
    assert adhoc.run(spark, f"SELECT {many} FROM events WHERE id IN (SELECT id FROM Events WHERE text LIKE '%reflect(%')", {"events": view}).count() == 5
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.read_only(spark, f"SELECT {many}, reflect('java.lang.System', 'nanoTime') FROM events", ["events"])


def test_pages_by_their_last_row_equal_pages_by_number(spark):
    rng = random.Random(2)
    rows = [(f"e{k:03d}", rng.choice([None, T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)]), rng.choice([None, 1, 2, 3])) for k in range(97)]
    df = spark.createDataFrame(rows, "event_id string, ts_utc timestamp, line_no int")
    after, number = None, 0
    while True:
        number += 1
        found = browse.page_after(df, after, 13).collect()
        assert found == browse.page(df, number, 13).collect()
        if (after := browse.cursor(found)) is None:
            break
    assert number == 9


def test_a_look_up_by_id_skips_row_groups(spark, tmp_path):
    store = files.EventStore(spark, f"{tmp_path}/s")
    e = events(spark, *[(k, k, "core", "a", "ERROR") for k in range(50)]).withColumns({c: F.lit(None).cast("string") for c in ("ts_raw", "ts_confidence", "raw")})
    for b in ("one", "two"):
        store.add(e, "f", 1, None, 1.0, b)
    some = store.events("two").first()["event_id"]
    for wanted, groups in ((some, 1), ("0" * 64, 0)):
        df = browse.by_id(spark.read.schema(store.STORED).parquet(store.events_path), wanted)
        assert len(df.collect()) == groups
        plan = df._jdf.queryExecution().executedPlan()
        leaf = (plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan).collectLeaves().apply(0)
        assert leaf.metrics().get("numOutputRows").get().value() <= 50 * groups  # of a hundred that are stored


def test_an_indexed_search_reads_few_files_and_finds_all(spark, tmp_path):
    from emberlog.sources.textindex import TextIndex, literal_parts

    assert literal_parts("%a\\\\b\\%c_d%") == ["a\\b%c", "d"]
    store = files.EventStore(spark, f"{tmp_path}/s")
    index = TextIndex(store)
    assert index.update() == 0

    def add(batch, *texts):
        rows = [(i, i, "Core" if i % 2 else None, t, "ERROR") for i, t in enumerate(texts)]
        e = events(spark, *rows).withColumns({c: F.lit(None).cast("string") for c in ("ts_raw", "ts_confidence", "raw")})
        store.add(e.withColumn("message", F.col("correlation_id")).coalesce(1), "f", 1, None, 1.0, batch)

    add("one", "Payment timeout at gate 7", "100% done", None, "")
    add("two", "payment accepted", "ÄRGER über Straße 😀😀x", "ab", "ΑΣ ΑΣΑ")
    add("three", "x" * 9000 + "needle" + "y" * 9000, "a\\b", "row_1", "rowX1")
    assert index.update() >= 3 and index.update() == 0
    add("later", "payment timeout again", "NEEDLE")
    full = store.events()
    few = {"timeout at": 2, "needle": 2, "ärger ÜBER": 2, "😀😀x": 2, "nothing like it": 1}
    for term in ("timeout at", "PAYMENT", "pay%out", "row_1", "e_d%", "needle", "xneedley", "ärger ÜBER", "😀😀x", "ασα", "ας", "100%", "a\\b", "ab", "", "core", "nothing like it"):
        for literal in (False, True):
            want = sorted(r["event_id"] for r in browse.matching(full, search=term, literal=literal).collect())
            df = index.search(term, literal)
            assert sorted(r["event_id"] for r in df.collect()) == want, term
            if term in few:
                everything = {r[0] for r in spark.read.schema(store.STORED).parquet(store.events_path).select("_metadata.file_path").distinct().collect()}
                assert len(everything) - len(index.without(term, literal)) == few[term], term
                kept = spark.read.schema(store.STORED).parquet(store.events_path).where(~F.col("_metadata.file_path").isin(index.without(term, literal)))
                kept.collect()
                plan = kept._jdf.queryExecution().executedPlan()
                leaf = (plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan).collectLeaves().apply(0)
                assert leaf.metrics().get("numFiles").get().value() == few[term]


def test_templates_move_a_text_for_each_leaf(spark, monkeypatch):
    """One shuffle, of merged lines and not of tokens, and the same templates however often a task passes on what it holds."""
    import re
    from collections import defaultdict

    from emberlog.operators import templates as module

    draw = random.Random(5)
    texts = [" ".join(draw.choice(("a", "b", "c7", "<*>", "é", "x\u00a0y")) for _ in range(draw.randint(1, 5))) for _ in range(600)] + ["a b common"] * 400 + [None, "", " \t\x0b", "\ta  b \r"]
    leaves = defaultdict(list)
    for x in texts:
        if tokens := [module.WILD if any(c.isdigit() for c in t) else t for t in re.split("[\x20\x09-\x0D]+", (x or "").strip(" \t\n\x0b\x0c\r")) if t]:
            leaves[(len(tokens), *tokens[:2])].append(tokens)
    merged = [(" ".join(p[0] if len(set(p)) == 1 else module.WILD for p in zip(*rows)), len(rows)) for rows in leaves.values()]
    expected = sorted((t, n, t.split(" ").count(module.WILD)) for t, n in merged)
    for held in (module.HELD, 500):
        monkeypatch.setattr(module, "HELD", held)
        found = module.templates(spark.createDataFrame([(t,) for t in texts], "message string").repartition(3))
        assert sorted(map(tuple, found.collect())) == expected
    plan = module.templates(spark.range(1).select(F.lit("a b").alias("message")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan


def test_templates_of_messages(spark):
    from emberlog.operators.templates import templates

    texts = [f"user {u} logged in from 10.0.0.{i}" for i, u in enumerate(("ann", "bob", "cy"))] + ["disk sda1 full", "disk sda2 full", "disk is full", "disk is full", "job done", "  job\tdone ", None, "", " "]
    got = {(r["template"], r["n"], r["n_wild"]) for r in templates(spark.createDataFrame([(t,) for t in texts], "message string")).collect()}
    want = {("user ann logged in from <*>", 1, 1), ("user bob logged in from <*>", 1, 1), ("user cy logged in from <*>", 1, 1), ("disk <*> full", 2, 1), ("disk is full", 2, 0), ("job done", 2, 0)}
    assert got == want
    shallow = {(r["template"], r["n"]) for r in templates(spark.createDataFrame([(t,) for t in texts], "message string"), depth=1).collect()}
    assert shallow == {("user <*> logged in from <*>", 3), ("disk <*> full", 4), ("job done", 2)}


#: Lines of seven kinds of logs; each proposed profile must read times, levels and messages of all of them.
def _kinds() -> dict[str, tuple[list[str], dict]]:
    at = [dt.datetime(2024, 3, 1, 10, 0, 0) + dt.timedelta(seconds=37 * i) for i in range(50)]
    level = ["INFO", "WARN", "ERROR", "DEBUG"]
    return {
        "access": ([f'10.0.0.{i} - - [{t:%d/%b/%Y:%H:%M:%S} +0000] "GET /a/{i} HTTP/1.1" 200 {i}12' for i, t in enumerate(at)], {"message": "GET /a/0 HTTP/1.1"}),
        "syslog": ([f"{t:%b %d %H:%M:%S} host{i % 3} sshd[{100 + i}]: session {i} opened" for i, t in enumerate(at)], {"message": "session 0 opened", "component": "sshd"}),
        "json": ([json.dumps({"timestamp": f"{t:%Y-%m-%dT%H:%M:%SZ}", "level": level[i % 4], "service": "pay", "message": f"paid order {i} in full"}) for i, t in enumerate(at)], {"message": "paid order 0 in full", "component": "pay", "level": "INFO"}),
        "csv": ([f'{t:%Y-%m-%d %H:%M:%S},{level[i % 4]},core,"order {i}, paid in full"' for i, t in enumerate(at)], {"message": "order 0, paid in full", "component": "core", "level": "INFO"}),
        "error": ([f"[{t:%Y-%m-%d %H:%M:%S}] [core:{level[i % 3].lower()}] [pid {i}:tid 7] [client 10.0.0.{i}] File {i} missing" for i, t in enumerate(at)], {"message": "File 0 missing", "level": "INFO"}),
        "service": ([f"{t:%Y-%m-%d %H:%M:%S}.123  {level[i % 4]} {100 + i} --- [main-{i % 2}] com.acme.Pay : Started part {i}" for i, t in enumerate(at)], {"message": "Started part 0", "level": "INFO"}),
        "bracket": ([f"[{t:%Y-%m-%d %H:%M:%S}] [{level[i % 4]}] [core{i % 2}] : took {i} ms" for i, t in enumerate(at)], {"message": "took 0 ms", "level": "INFO"}),
    }


@pytest.mark.parametrize("kind", ["access", "syslog", "json", "csv", "error", "service", "bracket"])
def test_profiles_are_proposed_from_lines(spark, kind):
    from emberlog.operators import ingest, profiles
    from emberlog.operators.templates import propose

    text, want = _kinds()[kind]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(text, 1)], "file_name string, line_no int, line string")
    ingested = F.lit(dt.datetime(2024, 6, 1))
    made = ingest.generate_profile(df, ingested, propose)
    rows = profiles.parse(profiles.records_of(df, made), made, ingested).orderBy("line_no").collect()
    assert len(rows) == 50 and all(r["parsed"] for r in rows)
    assert {k: rows[0][k] for k in want} == want, made
    assert str(rows[1]["ts_utc"])[5:] == "03-01 10:00:37"


def test_no_profile_is_proposed_for_prose(spark):
    from emberlog.operators.templates import propose

    with pytest.raises(ValueError):
        propose(["Once upon a time", "there was, as they say, nothing", ""], [])


def test_json_is_recovered_by_path_from_any_prefix():
    doc = {"a": {"b": [1, {"c": "x\\y\"z é"}, [True, None, -2.5e3]], "d": ""}, "e": [], "f": {"g": {}}, "h": "end"}
    for text in (json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False), json.dumps([doc, 7])):

        def leaves_of(x, path="$"):
            for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
                yield from leaves_of(v, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]")
            if not isinstance(x, (dict, list)):
                yield path, x

        whole = dict(leaves_of(json.loads(text)))
        assert payloads.recovered(text) == whole
        seen = {}
        for cut in range(len(text) + 1):
            got = payloads.recovered(text[:cut])
            assert got.items() <= whole.items() and seen.keys() <= got.keys()  # never wrong, and nothing that was complete is lost
            seen = got
    assert payloads.recovered('{"a": 1, "b": {"c": "x", "d": "cut of') == {"$.a": 1, "$.b.c": "x"}
    assert payloads.recovered("no json") == {} and payloads.recovered('{"a": 1} tail') == {"$.a": 1} and payloads.recovered("}{") == {}


def test_rule_store(spark, tmp_path):
    store = alerts.RuleStore(spark, f"file://{tmp_path}/rules")
    seeds = [r["rule_id"] for r in store.frame().collect()]
    assert len(seeds) == len(alerts.SEEDS)
    made = store.create(alerts.Rule("mine", "WARN", component_filter="x"))
    with pytest.raises(ValueError, match="one name"):
        store.create(alerts.Rule("mine"))
    new = store.update(made["rule_id"], component_filter="", dedup_window_minutes=5, min_level=None, enabled=False)
    assert (new["component_filter"], new["dedup_window_minutes"], new["min_level"], new["enabled"]) == (None, 5, "WARN", False)
    with pytest.raises(ValueError):
        store.update(made["rule_id"], min_level="LOUD")
    assert store.frame(enabled_only=True).count() == len(seeds) and [r["rule"] for r in store.frame().collect()][-1] == "mine"
    for i in (*seeds, made["rule_id"]):
        store.delete(i)
    assert alerts.RuleStore(spark, f"file://{tmp_path}/rules").frame().count() == 0
    with pytest.raises(KeyError):
        store.get(made["rule_id"])


def test_islands_over_hours(spark):
    """Blocks by hour give what one ordered sequence gives."""
    rng = random.Random(4)
    rows, t = [], T0
    for k in range(400):
        t += dt.timedelta(minutes=rng.choice((0, 1, 3, 9, 40, 200)))
        rows.append((f"{k:04d}", t, rng.choice(("unresponded", "unresponded", "responded", "pending"))))
    want, run = [], None
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for k, (i, at, status) in enumerate(ordered):
        if status != "unresponded":
            continue
        before = ordered[k - 1] if k else None
        if run is None or before[2] != "unresponded" or at - before[1] > dt.timedelta(minutes=10):
            run = [i, at, None, 0]
            want.append(run)
        run[3] += 1
        after = ordered[k + 1] if k + 1 < len(ordered) else None
        run[2] = after[1] if after and after[2] != "unresponded" else None
    got = correlate.downtime_islands(spark.createDataFrame(rows, "event_id string, ts_utc timestamp, status string")).orderBy("down_since", "first_event").collect()
    assert [(r["first_event"], r["recovered_at"], r["unresponded_count"]) for r in got] == [(i, b, n) for i, _, b, n in want]


def test_exceptions_and_operations(spark):
    said = "System.Net.WebException: host down\n   at A.B(Int32 x) in C:\\src\\a.cs:line 12\n   at C.D()\nmore"
    got = one(spark, text.exception(F.col("a")), a=said)
    assert got["type"] == "System.Net.WebException" and got["message"] == "host down" and got["additional_lines"] == ["more"]
    assert [(f["method"], f["file"], f["line"]) for f in got["frames"]] == [("A.B(Int32 x)", "C:\\src\\a.cs", 12), ("C.D()", None, None)]
    assert one(spark, text.exception(F.col("a")), a="all is well") is None
    assert [one(spark, text.operation(F.col("a")), a=u) for u in ("https://b/OTP-request", "https://b/setup-request/1", "https://b", None)] == ["OTP_REQUEST", "SETUP_REQUEST", "UNKNOWN", None]
    assert one(spark, text.plain_escapes(F.col("a")), a='=\\> \\"x\\"\\n') == '=> "x"\n'


def test_xml_trees():
    from emberlog.functions import payloads

    method, document, tags = payloads.read_xml("x <Msg><A>1</A><A>2</A><B><C>a & b</C></B></Msg> y")
    assert method == "xml" and json.loads(document) == {"A": ["1", "2"], "B": {"C": "a & b"}} and tags == {"a": "1", "c": "a & b"}
    method, document, tags = payloads.read_xml("<Msg><A>1</A><B>caf&eacute;</Msg><C>no</C>")
    assert method == "regex" and document is None and tags == {"a": "1"}
    assert payloads.read_xml("none") == (None, None, {})
    assert list(payloads.balanced('a {"x": "}\\"{"} b {"y": {') ) == [('{"x": "}\\"{"}', True), ('{"y": {', False)]


def test_outliers_come_furthest_first(spark):
    from emberlog.operators import browse

    counts = spark.createDataFrame([(f"h{k}", 10) for k in range(60)] + [("a", 60), ("b", 90)], "hour string, n long")
    assert [r["hour"] for r in browse.outliers(counts).collect()] == ["b", "a"]


def test_config(tmp_path):
    from emberlog.session import Config

    (tmp_path / "c.json").write_text(json.dumps({"store": "s", "grace_ms": 7}))
    got = Config.load(f"{tmp_path}/c.json", {"EMBERLOG_GRACE_MS": "9", "EMBERLOG_PROFILES": "hdfs://p"})
    assert (got.store, got.grace_ms, got.profiles, got.poll_seconds) == (f"{tmp_path}/s", 9, "hdfs://p", 60)


def test_thresholds_come_from_the_configuration(spark):
    from emberlog.operators import ingest
    from emberlog.session import Config

    rows = events(spark, (1, 0, "vplus_input", "a"), (2, 2, "vplus_response", "a"), (3, 10, "vplus_input", "b"), (4, 30, "vplus_response", "b"), (5, 3590, "vplus_input", "c"))
    now = T0 + dt.timedelta(hours=1)
    usual = reports.health(rows, now=now)
    assert usual["availability"] == reports.availability(rows, now=now) and usual["response_times"] == reports.response_times(rows)
    assert usual["sms"] == reports.sms_flows(rows) and [usual["availability"][k] for k in ("responded", "unresponded", "delayed")] == [2, 1, 2]
    patient = reports.health(rows, Config(expected_ms=3000, grace_ms=60000), now=now)
    assert [patient["availability"][k] for k in ("responded", "unresponded", "delayed")] == [2, 0, 1]
    assert patient["response_times"]["expected_response_ms"] == 3000
    call = Config(max_bytes=7).of(ingest.ingest)
    assert call.keywords == {"max_bytes": 7} and Config().of(ingest.ingest, max_bytes=1).keywords == {"max_bytes": 1}
