"""Records of formats with parsers of their own, from fresh sample lines."""

import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators.formats import by_key, canonical, detect_format, formats, older, score_on

US = "8/5/2026 8:17:33 PM"


def rows(fmt, lines):
    return [(r, json.loads(r["details"])) for r in by_key(fmt).records(lines).orderBy("ordinal").collect()]


CREDIT = f"""noise before the first record
{US} Log Tracker No: T1 => CC_Enquiry Inputs-:Data in CC_Enquiry(OrgNo=001, CIF = 42 ,CIF=43)
{US} Log Tracker No: T1 => Request -: <?xml version="1.0"?><Iso8583PostXml><MsgType>0200</MsgType>
<Fields><F2>4111</F2><F4>10.5</F4></Fields></Iso8583PostXml>
{US} Log Tracker No: T2 => Warrning slow answer"""


def test_abce_credit(lines):
    got = rows("abce_credit", lines(CREDIT))
    assert [r["log_type"] for r, _ in got] == ["FUNCTION_INPUT", "XML_PAYLOAD", "WARNING"]
    assert [r["correlation_id"] for r, _ in got] == ["T1", "T1", "T2"]
    assert got[0][0]["action"] == "CC_Enquiry" and got[0][1]["parameters"] == {"OrgNo": "001", "CIF": "43"}
    assert got[1][0]["action"] == "Request" and got[1][1] == {"msg_type": "0200", "fields": {"F2": "4111", "F4": "10.5"}}
    assert got[2][0]["action"].startswith("Warrning")


def test_broken_xml(lines):
    broken = "<?xml version='1.0'?><IsoPostXml><MsgType>0800</MsgType><Fields><A>1</B></Fields>"
    assert rows("abce_credit", lines(f"{US} Log Tracker No: T => x {broken}"))[0][1] == {"raw_xml": broken}
    got = rows("abce_debit", lines(f"{US} -> 123---x {broken}"))[0]
    assert got[1]["msg_type"] == "0800" and got[0]["correlation_id"] == "123" and got[1]["fields"]


def test_debit_portals(lines):
    text = f"{US} ->12---Inputs in GetCards(Id=7, Kind=x)\n{US} ->-------\n{US} ->34---New Request came\n{US} ->56---A warning"
    got = rows("abce_debit", lines(text))
    assert [(r["log_type"], r["correlation_id"]) for r, _ in got] == [("FUNCTION_INPUT", "12"), ("STEP_EVENT", "34"), ("WARNING", "56")]
    assert got[0][1]["parameters"] == {"Id": "7", "Kind": "x"}
    assert [r["log_type"] for r, _ in rows("asbb_debit", lines(text))][0] == "FUNCTION_INPUT"


def test_middleware_keeps_levels_and_splits_joined_records(lines):
    a = "2026-08-05 20:17:33.123 +00:00 [INFO] Log Tracker No: M1 => Inputs : CC_X (OrgNo=1,CIF=2)"
    b = "2026-08-05 20:17:34.000 +02:00 [ERROR] plain"
    got = rows("asbb_mw_credit", lines(a + b))
    assert [r["log_level"] for r, _ in got] == ["INFO", "ERROR"]
    assert got[0][0]["action"] == "CC_X" and got[0][1]["parameters"] == {"OrgNo": "1", "CIF": "2"}


def test_detection(spark, lines):
    mw = "2026-08-05 20:17:33.123 +00:00 [INFO] x"
    assert detect_format(mw)[0].key == "asbb_mw_credit" and detect_format("nothing") == (None, [])
    text = f"{US} ->12---Inputs in GetCards(Id=7)"
    best, warnings = detect_format(text, score_on(lines(text)))
    assert best.key in ("abce_debit", "asbb_debit") and len(warnings) == 1


def test_canonical(spark, lines):
    fmt = by_key("abce_credit")
    got = canonical(fmt.records(lines(CREDIT)), fmt, F.lit("2026-01-01 00:00:00").cast("timestamp")).orderBy("line_no").collect()
    assert [r["level"] for r in got] == ["INFO", "INFO", "WARN"]
    assert str(got[0]["ts_utc"]) == "2026-08-05 20:17:33" and got[0]["ts_confidence"] == "parsed"
    assert json.loads(got[0]["attributes"])["correlation_id"] == "T1" and got[0]["source_system"] == "abce_credit_portal"


AFS = f"""{US} Log Tracker No: SU001 => Request Body {{"TransactionId": "X1", "IssuerId": "I9", "MerchantInfo": {{"MerchantName": "Shop"}}, "Credentials": [{{"Type": "SMS", "Text": "+4912345678"}}]}}
{US} Log Tracker No: IA002 => {{"TransactionId": "X1", "StepupRequestId": "R1"}}
{US} Log Tracker No: IA002 => OTP processed successfully
{US} Log Tracker No: SU003 => gateway timeout
not a record"""


def test_afs(lines):
    got = rows("afs_netcetera", lines(AFS))
    assert [r["log_type"] for r, _ in got] == ["request_body", "other", "otp_success", "error", "unparsed"]
    assert [r["correlation_id"] for r, _ in got] == ["X1", "X1", "X1", "SU003", None]
    tx = got[0][1]["transaction"]
    assert tx["issuer_id"] == "I9" and tx["merchant"]["name"] == "Shop" and tx["otp_processed"] and tx["customer"]["mobile"] == "+4912345678"
    assert tx["trackers"] == ["SU001", "IA002"] and tx["derived"]["is_success"]
    assert [r["log_level"] for r, _ in got] == ["INFO", "INFO", "INFO", "ERROR", "WARN"]
    assert got[4][1] == {"raw": "not a record", "line_no": 5} and got[4][0]["ts_raw"] is None


OTP = f"""{US} : Msg Received-- &lt;Msg&gt;&lt;Header&gt;&lt;mtrackingid&gt;IA77&lt;/mtrackingid&gt;&lt;Org&gt;001&lt;/Org&gt;&lt;/Header&gt;&lt;Body&gt;&lt;TranAmount&gt;12.5&lt;/TranAmount&gt;&lt;MerchantName&gt;A & B&lt;/MerchantName&gt;&lt;/Body&gt;&lt;/Msg&gt;
{US} : Message for Queue=mq-push
{US} : SMS placed in queue MsgId: M1
{US} : OTP processed successfully
{US} : Force verify by mobile
{US} : something else"""


def test_otp_carries_the_pending_tracker(lines):
    got = rows("otp_processor", lines(OTP))
    assert [r["log_type"] for r, _ in got] == ["msg_received_sms_xml", "queue", "sms_queue_msg_id", "otp_success", "force_verify_by_mobile", "other"]
    assert [r["correlation_id"] for r, _ in got] == ["IA77"] * 5 + [None]
    record = got[1][1]["record"]
    assert record["org"] == "001" and record["merchant"]["name"] == "A & B" and record["transaction"]["amount"] == 12.5
    assert record["otp_processed"] and record["force_verify_by_mobile"] and record["queue"] == "mq-push" and record["msg_id"] == "M1"
    assert got[5][0]["log_level"] == "WARN" and "record" not in got[5][1]


def test_debit_portal(lines):
    text = f'{US} Log Tracker No: SU9 => Debit Request : {{"TransactionId": "D1", "IssuerId": "I1", "Status": "SUCCESS", "TransactionInfo": {{"TransactionCurrency": "QAR"}}}}\n{US} OTP processed successfully\n{US} System failed\n   at A.b() in c.cs:line 3\n{US} Debit Response : {{"TransactionId": "D'
    got = rows("debit_portal_log", lines(text))
    assert [r["log_type"] for r, _ in got] == ["debit_request_json", "otp_success", "error", "debit_response_json"]
    tx = got[1][1]["transaction"]
    assert tx["issuer_id"] == "I1" and tx["status"] == "SUCCESS" and tx["transaction"]["currency"] == "QAR" and tx["integrity_status"] == "CHECK"
    assert got[3][1]["parse_status"] == "partial" and got[3][0]["log_level"] == "WARN"


def test_cardinal_aliases(lines):
    text = "\n".join(
        [
            f'{US} Log Tracker No: SU1 => Request Body {{"TransactionId": "C1", "StepupRequestId": "S1", "StepupType": "OTP"}}',
            f'{US} Log Tracker No: IA2 => {{"StepupRequestId": "S1"}}',
            f"{US} Log Tracker No: IA2 => InitiateActionCallController placed in queue (AFS.OTP.Q)",
            "   at Some.Method()",
            f"{US} Log Tracker No: VL3 => ResponseCode=00 BankOrg=777",
        ]
    )
    got = rows("cardinal", lines(text))
    assert [r["log_type"] for r, _ in got] == ["request_body", "message", "otp_queue", "vplus_result"]
    assert [r["correlation_id"] for r, _ in got] == ["C1", "C1", "C1", "VL3"]
    flow = got[2][1]["flow"]
    assert flow["trackers"] == ["SU1", "IA2"] and flow["queue"] == "AFS.OTP.Q" and "OTP flow has no processed-success confirmation" in flow["warnings"]
    assert got[2][0]["raw"].endswith("at Some.Method()") and got[3][1]["flow"]["bank_org"] == "777"


def test_vflex(lines):
    text = f'{US} Log Tracker No: IA5 => Success Response from Bank API call {{"success": true, "TransactionId": "V1"}}\n{US} Log Tracker No: IA5 => OTP processed successfully\n{US} SQL connection established success'
    got = rows("vflex", lines(text))
    assert [r["correlation_id"] for r, _ in got] == ["V1", "V1", None]
    tx = got[1][1]["transaction"]
    assert tx["bank_api"]["success"] is True and tx["otp_state"]["processed_successfully"] and "OTP value was not extracted" in tx["warnings"]


def test_vflex_with_escaped_signs(lines):
    text = f'{US} Log Tracker No: IA5 =\\> Msg Received-- \\<Msg\\>\\<Body\\>\\<Mobile\\>+4179\\</Mobile\\>\\</Body\\>\\</Msg\\>\n{US} Log Tracker No: IA5 =\\> list \\[{{"TransactionId": "V\\"2"}}\\]'
    got = rows("vflex", lines(text))
    assert [r["correlation_id"] for r, _ in got] == ['V"2', 'V"2'] and got[0][1]["transaction"]["customer"]["mobile"] == "+4179"
    assert got[0][0]["action"].startswith("Msg Received-- <Msg>")


def test_credentials_flags_and_calls(lines):
    """Of several credentials the last counts with AFS and the first elsewhere; five flags are never null; errors name call and address."""
    body = '{"TransactionId": "T1", "Credentials": [{"Type": "SMS", "Text": "+111"}, {"Type": "SMS", "Text": "+222"}, {"Type": "EMAIL", "Text": "a@b"}]}'
    for key, mobile in (("afs_netcetera", "+222"), ("vflex", "+111")):
        entity = rows(key, lines(f"{US} Log Tracker No: SU1 => Request Body {body}"))[0][1]["transaction"]
        assert entity["customer"]["mobile"] == mobile
        assert entity["derived"] == {"has_sms": True, "has_email": True, "has_stepup": True, "has_initiate_action": False, "is_success": False}
    text = f"{US} Log Tracker No: IA7 => Error in Bank Validate Call : https://bank/x?y=1\nSystem.TimeoutException: no answer\n   at A.B() in C.cs:line 3"
    details = rows("debit_portal_log", lines(text))[0][1]
    assert details["error_call"] == "Bank Validate" and details["error_url"] == "https://bank/x?y=1" and details["exception"]["type"] == "System.TimeoutException"


def test_cardinal_fields_outside_of_payloads(lines):
    text = "\n".join(
        [
            f'{US} Log Tracker No: SU1 => Request Body {{"TransactionId": "C1", "StepupRequestId": "S1", "StepupType": "OOB"}}',
            f"{US} Log Tracker No: SU1 => ResponseCode=05 BankOrg=777 CustomerId=K-12 EnableOOB=Y cardBlocked=false",
            f"{US} Log Tracker No: SU1 => ResponseCode=00 CustomerId: K-99 EnableOOB=N cardBlocked: true",
            f"{US} Log Tracker No: SU1 => cardBlocked=false",
        ]
    )
    got = rows("cardinal", lines(text))
    flow = got[0][1]["flow"]
    assert flow["customer"]["customer_id"] == "K-12" and flow["oob"] == {"status_history": [], "enabled": "Y", "card_blocked_history": [False, True]}
    assert flow["vplus"]["response_code"] == "05" and [d.get("response_code") for _, d in got] == [None, "05", "00", None]


def test_payloads_with_any_reference(lines):
    """Numeric references, and named ones beyond XML's, as html.unescape() reads them."""
    for key, quote in (("afs_netcetera", "&#34;"), ("vflex", "&#x22;"), ("debit_portal_log", "&#X22;")):
        plain = f'{US} Log Tracker No: SU1 => Request Body {{"TransactionId": "X1", "IssuerId": "Caf&eacute;", "MerchantInfo":&#10;{{"MerchantName": "m"}}}}'
        head, body = plain.split("{", 1)
        got = rows(key, lines(head + "{" + body.replace('"', quote)))
        assert got[0][0]["correlation_id"] == "X1" and json.dumps(got[0][1], ensure_ascii=False).count("Café"), key
    xml = "<Msg><Header><mtrackingid>IA77</mtrackingid></Header><Body><MerchantName>Caf&eacute; &amp;#38; Co</MerchantName></Body></Msg>"
    got = rows("otp_processor", lines(f"{US} : Msg Received-- " + xml.replace("<", "&#60;").replace(">", "&#x3e;")))
    assert got[0][0]["log_type"] == "msg_received_sms_xml" and got[0][0]["correlation_id"] == "IA77" and got[0][1]["record"]["merchant"]["name"] == "Café & Co"


@pytest.mark.parametrize("key", ["abce_credit", "abce_debit", "asbb_debit", "asbb_mw_credit", "afs_netcetera", "otp_processor", "debit_portal_log", "cardinal", "vflex", "abce_credit_older", "asbb_mw_credit_older", "unified_portal"])
def test_empty_files(lines, key):
    assert by_key(key).records(lines("")).count() == 0


OLDER_CREDIT = f"""{US} Log Tracker No: T1 => Inputs CC_Enquiry(PCINumber=1234567890, CIF=42, Org=001)
{US} no tracker, so it belongs to the record before
{US} Log Tracker No: T1 => CC_Enquiry mqRetry : 3 Calling Method : {{ Send }} VP_Response: 00 fine
{US} Log Tracker No: T1 => CC_Enquiry End of Request
{US} Log Tracker No: T2 => text: <Iso8583PostXml><MsgType>0200</MsgType><Fields><F2>4111</F2></Fields></Iso8583PostXml>
{US} Log Tracker No: T2 => a Warrning
{US} Log Tracker No: T3 => anything"""


def test_older_credit(spark, lines):
    got = rows("abce_credit_older", lines(OLDER_CREDIT))
    assert [r["log_type"] for r, _ in got] == ["FUNCTION_INPUT", "FUNCTION_RESPONSE", "REQUEST_END", "XML_PAYLOAD", "WARNING", "GENERIC"]
    assert [r["action"] for r, _ in got] == ["CC_Enquiry", "CC_Enquiry", "CC_Enquiry", "text", "a Warrning", "anything"]
    parameters = got[0][1]["parameters"]
    assert parameters["PCINumber"] == "1234**7890" and parameters["CIF"] == "42" and parameters["Org"] == "001"
    assert (got[1][0]["retry_count"], got[1][0]["calling_method"], got[1][1]) == (3, "Send", {"response": "00 fine"})
    assert got[3][1] == {"msg_type": "0200", "fields": {"F2": "4111"}} and got[0][0]["retry_count"] is None
    fmt = by_key("abce_credit_older")
    events = canonical(fmt.records(lines(OLDER_CREDIT)), fmt, F.lit("2026-01-01 00:00:00").cast("timestamp")).orderBy("line_no").collect()
    told = [json.loads(r["attributes"]) for r in events]
    assert told[1]["retry_count"] == 3 and told[1]["correlation_id"] == "T1" and "retry_count" not in told[0]
    counted = older.by_transaction(fmt.records(lines(OLDER_CREDIT))).collect()
    assert {(r["correlation_id"], r["event_count"]) for r in counted} == {("T1", 3), ("T2", 2), ("T3", 1)} and len(counted) == 6


def test_older_middleware(lines):
    head = "2026-08-05 20:17:33.123 +00:00 [INFO] "
    broken = "<IsoPostXml><MsgType>0800</MsgType><A>1</A>"
    bodies = ["Log Tracker No: M1 => Inputs : (A=1,B=2)", "Log Tracker No: M1 => Inputs CC_X without a colon (A=1)", "CC_X Response: MQRETRY 4", f"Log Tracker No: M2 => sent -: {broken}", "a Timeout came", "warning: timeout", "plain text", "PostXml> alone"]
    got = rows("asbb_mw_credit_older", lines("".join(head + b for b in bodies)))
    assert [r["log_type"] for r, _ in got] == ["FUNCTION_INPUT", "FUNCTION_INPUT", "FUNCTION_RESPONSE", "XML_PAYLOAD", "ERROR", "WARNING", "GENERIC", "XML_PAYLOAD"]
    assert [r["action"] for r, _ in got] == ["Inputs", "Inputs CC_X without a colon (A=1)", "CC_X", "sent", "a Timeout came", "warning: timeout", "plain", "XML API Request"]
    assert got[0][1]["parameters"] == {"A": "1", "B": "2"} and got[1][1] == {} and got[2][1] == {"response": "CC_X Response: MQRETRY 4"}
    assert got[2][0]["retry_count"] == 4 and got[2][0]["log_level"] == "INFO" and got[2][0]["correlation_id"] is None
    assert got[3][1]["msg_type"] == "0800" and got[3][1]["raw_xml"] == broken and got[3][1]["fields"]["A"] == "1"


def test_unified(lines):
    us = f"{US} -> 12—3---Inputs in GetCards(Id=7)\n{US} ->-----\n{US} => CC_Pay mqRetry:2 VP_Response:17\n{US} Log Tracker No: T-1 => hello"
    iso = "2026-08-05 20:17:33.123 +00:00 [WARN] Log Tracker No: M1 => VP_Response:9\n" + f"{US} -> stays in the record above"
    got = rows("unified_portal", lines(us, "us.log").unionByName(lines(iso, "iso.log")))
    by_file = {name: [(r, d) for r, d in got if r["file_name"] == name] for name in ("us.log", "iso.log")}
    assert [(r["log_type"], r["correlation_id"], r["action"], r["log_level"]) for r, _ in by_file["us.log"]] == [
        ("FUNCTION_INPUT", "12", "GetCards", "INFO"), ("RESPONSE_PAYLOAD", None, "CC_Pay", "INFO"), ("INFO", "T1", "hello", "INFO")
    ]
    assert by_file["us.log"][1][1] == {"mq_retry": "2", "vp_response": "17"} and by_file["us.log"][0][1]["parameters"] == {"Id": "7"}
    only = by_file["iso.log"]
    assert len(only) == 1 and only[0][0]["log_level"] == "WARN" and only[0][1] == {"vp_response": "9"} and "stays" in only[0][0]["raw"]


def test_older_forms_are_read_only_where_named():
    assert not any(f.detect(OLDER_CREDIT) for f in older.FORMATS) and set(older.FORMATS) <= set(formats())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_read_once_for_their_records(spark):
    """Records within a block, over the end of one and over several, from lines that are computed once."""
    import random

    from emberlog.operators.formats import split_records

    draw, seen = random.Random(3), spark.sparkContext.accumulator(0)
    texts = [draw.choice(("H one", "two", "", "H ", None)) if not 40 <= i < 90 else "in between" for i in range(200)]
    rows = [(f, i, i // 20, x) for f in ("a", "b") for i, x in enumerate(texts if f == "a" else texts[7:])]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    shape = "file_name string, line_no int, block long, line string"
    found = split_records(spark.createDataFrame(rows, shape).repartition(3).mapInArrow(counted, shape), "H ").collect()
    expected, last = [], {}
    for f, _, _, x in rows:
        if x is not None and x.startswith("H "):
            last[f] = last.get(f, 0) + 1
            expected.append([f, last[f], x[2:]])
        elif x is not None and f in last:
            expected[-1][2] += "\n" + x
    assert sorted((r["file_name"], r["ordinal"], r["header"], r["body"]) for r in found) == sorted((f, k, "H ", x.strip()) for f, k, x in expected)
    assert seen.value == len(rows)


def test_events_find_their_entity_by_one_join(spark, lines):
    """Heads come with entities, flows are walked once, and an entity's document isn't parsed for a filter as well."""
    from emberlog.plans import catalogue

    text = "\n".join(f'1/2/2026 3:04:0{i} PM Log Tracker No: SU00{i % 3} => Request Body {{"TransactionId": "X{i % 3}", "StepupRequestId": "S"}}' for i in range(9))
    assert _plan(by_key("vflex").records(lines(text))).count("Join") == 1
    cardinal = by_key("cardinal").records(lines(text))
    assert "MapInArrow" not in _plan(cardinal) and {r["correlation_id"] for r in cardinal.collect()} == {"X0"}
    fields = catalogue.entity_fields(spark, None, "cardinal", lines(text), "flow", {"id": "$.transaction_id", "none": "$.no"})
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    assert [tuple(r) for r in fields.collect()] == [("a.log", "X0", "X0", None)]


def test_debit_events_carry_trackers_once_for_their_keys(lines):
    """The carried trackers aren't carried once more to learn what transactions they name."""
    text = '1/2/2026 3:04:05 PM -> Log Tracker No: SU001 => Request Body {"TransactionId": "X1"}\n1/2/2026 3:04:06 PM -> Error in Bank Call : https://b/1'
    found = by_key("debit_portal_log").records(lines(text))
    assert [r["correlation_id"] for r in found.orderBy("ordinal").collect()] == ["X1", "X1"]
    assert _plan(found).count("Join") == 5


def test_patterns_are_tried_where_their_signs_are(spark):
    """Finds equal those of patterns that are tried on every text."""
    from emberlog.functions import text as module

    texts = ["see HTTP://x https://a/b?c=1 http://b", "A@B.co x@y", "+12345678 10.0.0.1", "XXXX1234 xxxx9876 ****1111", "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "hTTp 500", "ERROR CODE: a-1", "AFS.q MsgID: k", "", "plain", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias(n) for n, p in module.OBSERVABLES.items()]
    assert rows.select(module.observables(F.col("t")).alias("o")).select("o.*").collect() == rows.select(*plain).collect()


def test_payment_lines_number_events_once(spark, tmp_path):
    from emberlog.plans import catalogue

    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, id % 3 AS user_id, if(id % 2 = 0, 'error', 'view') AS event_type, 1.0D AS value, '{}' AS props FROM range(8)").write.parquet(f"{tmp_path}/events.parquet")
    found = catalogue.payment_lines(spark, str(tmp_path))
    assert _plan(found).count("row_number()") == 1 or _plan(found).count("Window [row_number()") == 1
    assert found.count() == 12 and found.where("line LIKE '   at Bank.Call%'").count() == 4


def test_summary_of_records_writes_no_documents(spark, lines, monkeypatch):
    """Documents are parsed before the write, which holds what the counts need."""
    from emberlog.operators import summaries

    kept = []
    monkeypatch.setattr(summaries, "written", lambda df: kept.append(df.columns) or df)
    rows = spark.createDataFrame([("a", 1, "INFO", "x", None, '{"phase": "P", "flow": {"issuer_id": "i"}}')], "file_name string, ordinal long, log_type string, correlation_id string, log_level string, details string")
    found = {(r["dimension"], r["value"], r["n"]) for r in summaries.record_summary(rows).collect()}
    assert found == {("event_type", "INFO", 1), ("level", "INFO", 1), ("phase", "P", 1), ("issuer", "i", 1)}
    assert kept == [["file_name", "ordinal", "log_type", "correlation_id", "level", "parse_status", "phase", "entity"]]


def test_first_entities_need_no_write(spark, monkeypatch):
    from emberlog.operators import summaries

    monkeypatch.setattr(summaries, "written", None)
    rows = [("c", 2, '{"details": {"flow": {"b": 1}}}'), ("c", 1, '{"details": {"flow": {}}}'), ("c", 3, '{"details": {"flow": {"b": 2}}}'), ("d", 1, '{"details": {}}'), (None, 1, '{"details": {"flow": {"b": 3}}}')]
    events = spark.createDataFrame(rows, "correlation_id string, line_no int, attributes string").withColumns({"ts_utc": F.lit(None).cast("timestamp"), "event_id": F.lit("e")})
    assert [tuple(r) for r in summaries.entities(events, "cardinal").collect()] == [("c", '{"b":1}')]
    assert [tuple(r) for r in summaries.entities(events, "cardinal", latest=True).collect()] == [("c", '{"b":2}')]


def test_failures_are_told_without_entities(spark, lines, tmp_path, monkeypatch):
    """Failures of events as they are read equal those of canonical ones; no entity is merged for them and no document written."""
    from emberlog.operators import summaries
    from emberlog.operators.formats import payments
    from emberlog.plans import catalogue

    said = ['Request Body {"TransactionId": "X1"}', 'Request Body {"TransactionId": "X1", "Sta', "an error came", "an &#101;rror came", "no&nbsp;failure", "", "Bank API URL https://b/setup-request", "Error response from bank api call {}", "<Msg><a>1</b></Msg>"]
    text = "\n".join(f"{US} Log Tracker No: SU00{i % 3} => {x}" for i, x in enumerate(said)) + f"\n{US} without a tracker {{\n   at A.B() in c.cs:line 1"
    fmt, shape = by_key("vflex"), ("message", "warnings")
    whole = summaries.failed(canonical(fmt.records(lines(text)), fmt, F.lit("2026-01-01").cast("timestamp")), "vflex")
    found = summaries.failed_as_read(payments.vflex_events(lines(text)))
    assert sorted(map(tuple, found.select(*shape).collect())) == sorted(map(tuple, whole.select(*shape).collect()))
    assert found.count() == 6 and "to_json" not in _plan(found).lower()

    monkeypatch.setattr(payments, "merge", None)
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, id % 3 AS user_id, if(id % 2 = 0, 'error', 'view') AS event_type, 1.0D AS value, '{}' AS props FROM range(8)").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["n"] for r in catalogue.QUERIES["failed_events"](spark, str(tmp_path)).collect()] == [4]


def test_texts_without_signs_are_not_scanned(spark, monkeypatch):
    """A message that can hold no payload is its own text; rare characters are searched for, not looked up one by one."""
    from emberlog.functions import payloads, text as module

    plain = ["", "plain", "a > b; c = }", None]
    expected = [{"text": t, "status": None, "objects": [], "fields": {}, "paths": {}, "method": None, "document": None, "tags": {}} for t in plain]
    with monkeypatch.context() as m:
        m.setattr(payloads, "balanced", None)
        assert [payloads._scan(t) for t in plain] == expected
    marked = ["&amp;", "a\u00a0b", '{"a": 1}', "<Msg><a>1</a></Msg>"]
    assert [payloads._scan(t)["text"] for t in marked] == ["&", "a b", '{"a": 1}', "<Msg><a>1</a></Msg>"]
    assert payloads._scan(marked[2])["fields"] == {"a": "1"} and payloads._scan(marked[3])["tags"] == {"a": "1"}
    odd = ["\ufeff x\x00y\ufeff\r\n", "\x00\ufeff\x00", " \x0b\f", "é\x00𝄞 ", "", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(module.clean(F.col("t")).alias("c"))
    assert [r["c"] for r in rows.collect()] == [None if t is None else t.replace("\x00", "").replace("\ufeff", "").strip(" \t\r\n\x0b\f") for t in odd]
    assert "translate(" not in _plan(rows)
