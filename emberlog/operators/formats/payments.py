"""Payment logs with trackers: events by ordered classes, payload fields, and entities merged over a file's events.

Each format says how a line becomes an event and which key ties events together. The rest is shared: fields of JSON
and XML payloads, merges that keep the first or last non-empty value in order, integrity warnings, and the finished
entity joined back to each of its events. Keys hold within a file, as trackers are only unique there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.payloads import payload
from emberlog.functions.text import base64_text, clean, contains_any, exception, observables, operation, otp_message, phase, plain_signs, unescape_all
from emberlog.operators.correlate import carried, first_nonempty, last_nonempty, ordered_distinct, resolve_aliases, truthy
from emberlog.operators.formats import US_TIME, Format, classify, split_records
from emberlog.session import written

TRACKED = rf"{US_TIME}\s+Log Tracker No:\s*[A-Z]{{2}}\d+\s*(?:=>|=\\>|=&gt;)\s*"


def has(*parts: str) -> Callable[[Column], Column]:
    """All parts in the lower-cased text."""

    def holds(text: Column) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & F.contains(F.lower(text), F.lit(p))
        return out

    return holds


def any_of(*parts: str) -> Callable[[Column], Column]:
    return lambda text: contains_any(F.lower(text), *parts)


def matches(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


#: Classes in order, the first that holds counts.
AFS_CLASSES = (
    ("request_body", has("request body")),
    ("vplus_input", has("stepupcall v+ input message")),
    ("vplus_response", has("stepupcall v+ response message")),
    ("netcetera_response", any_of("stepup responce to netcetra", "stepup response to netcetra")),
    ("sms_input", has("sms input message")),
    ("sms_queue", has("sms placed in queue")),
    ("email_message", has("sendemail mqemailsmg message")),
    ("otp_success", has("otp processed successfully")),
    ("error", any_of("error", "exception", "failed", "timeout")),
)
OTP_CLASSES = (
    ("msg_received_sms_xml", has("msg received--", "<msg>")),
    ("sms_input_xml", has("sms input message", "<msg>")),
    ("email_xml", has("sendemail mqemailsmg message", "<emailmsg>")),
    ("queue", has("message for queue=")),
    ("otp_success", has("otp processed successfully")),
    ("sms_queue_msg_id", has("sms placed in queue")),
    ("force_verify_by_mobile", has("force verify by mob")),
)
DEBIT_CLASSES = (
    ("request_body_json", has("request body", "{")),
    ("netcetera_response_json", any_of("stepup responce to netcetra", "stepup response to netcetra")),
    ("debit_request_json", has("debit", "request", "{")),
    ("debit_response_json", has("debit", "response", "{")),
    ("msg_received_xml", has("msg received--", "<msg>")),
    ("sms_input_xml", has("sms input message", "<msg>")),
    ("email_xml", has("sendemail", "<emailmsg>")),
    ("queue", has("message for queue")),
    ("queue_msg_id", has("msgid:")),
    ("otp_success", has("otp processed successfully")),
    ("postilion", any_of("postilion", "postailion")),
    ("error", any_of("error", "exception", "failed", "timeout")),
    ("key_value", has("=")),
)
CARDINAL_CLASSES = (
    ("vplus_mq_timeout", has("error on stepupcall v+")),
    ("oob_http_error", has("oob tracker id:", "error http")),
    ("web_exception", has("webexception:")),
    ("oob_validate_exception", has("exception during validate api call")),
    ("oob_empty_status_response", has("oob status api returned null or empty")),
    ("oob_status_api_error", has("invokeoobapiget", "error code:")),
    ("request_body", has("request body")),
    ("cardinal_stepup_response", any_of("stepup response to cardinal", "stepup responce to cardinal")),
    ("cardinal_validate_response", any_of("validatecall response to cardinal", "validate response to cardinal")),
    ("vplus_input", has("stepupcall v+ input message")),
    ("vplus_response", has("stepupcall v+ response message")),
    ("otp_queue", has("initiateactioncallcontroller", "placed in queue")),
    ("otp_input", has("initiateactioncallcontroller", "input message")),
    ("initiate_action", has("initiateactioncallcontroller")),
    ("otp_success", has("otp processed successfully")),
    ("validate_call", has("validatecall")),
    ("oob_authenticate_api", has("/process/authenticate")),
    ("oob_validate_api", has("/process/validate")),
    ("oob_status_poll", any_of("/process/status/", "/status/")),
    ("vplus_result", any_of("responsecode=", "responsecode:")),
    ("error", any_of("error", "exception")),
)
ERROR_WORD = r"(?i)\b(error|failed|failure|exception|timeout|unreachable)\b"
VFLEX_CLASSES = (
    ("sql_connection_success", has("sql connection established success")),
    ("request_body", has("request body")),
    ("vf_input", has("stepupcall vf input message")),
    ("bank_request", has("get data from bank payload")),
    ("bank_api_url", has("bank api url")),
    ("bank_api_success_response", has("success response from bank api call")),
    ("bank_api_error_response", has("error response from bank api call")),
    ("netcetera_stepup_response", any_of("stepup response to netcetra", "stepup responce to netcetra")),
    ("sms_input", has("initiateactioncallcontroller", "sms input message")),
    ("sms_queue", has("initiateactioncallcontroller", "sms placed in queue")),
    ("otp_success", has("otp processed successfully")),
    ("error", matches(ERROR_WORD)),
)
#: An entity's field, the payload key it comes from, and the XML tags that may hold it too.
FIELDS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("issuer_id", "issuerid", ()),
    ("processor_id", "processorid", ()),
    ("stepup_request_id", "stepuprequestid", ()),
    ("verification_token", "verificationtoken", ()),
    ("auth_type", "stepuptype", ()),
    ("mobile", "@mobile", ("Mobile",)),
    ("email", "@email", ("EmailTo",)),
    ("oob_id", "@oob", ()),
    ("merchant_name", "merchantname", ("MerchantName",)),
    ("merchant_id", "merchantid", ("MerchantId",)),
    ("merchant_url", "merchanturl", ("MerchantURL",)),
    ("merchant_country", "merchantcountrycode", ("MerchantCountryCode",)),
    ("merchant_category", "merchantcategorycode", ()),
    ("amount_raw", "transactionamount", ("TranAmount",)),
    ("currency", "transactioncurrency", ("TranCurrency",)),
    ("tran_time", "transactiontimestamp", ("TranTime",)),
    ("card_number", "cardnumber", ("MaskedCardNo",)),
    ("expiry_month", "cardexpirymonth", ()),
    ("expiry_year", "cardexpiryyear", ()),
    ("org", "org", ("Org",)),
    ("otp", "otp", ("OTP",)),
)


#: What is wrong with an event or an entity, in the words that reports quote.
WARNINGS = {
    "no time": "Timestamp was not found",
    "no tracker": "Tracker number was not found",
    "no object": "JSON marker found but no JSON object was recovered",
    "broken object": "One or more JSON objects required fallback parsing",
    "broken xml": "XML required fallback parsing",
    "no tracker in xml": "no tracker in XML",
    "flow without transaction": "No TransactionId found",
    "flow without tracker": "No tracker found",
    "otp without queue": "OTP flow has no SMS queue confirmation",
    "otp without success": "OTP flow has no processed-success confirmation",
    "oob pending": "OOB flow remains pending in the captured log",
    "flow with errors": "Flow contains one or more errors",
    "step-up without transaction": "Step-up flow has no TransactionId",
    "step-up without bank": "Step-up flow has no successful bank API confirmation",
    "step-up without response": "Step-up flow has no successful Netcetera response",
    "no otp": "OTP value was not extracted",
    "no queue": "No SMS queue confirmation",
    "no success": "No OTP processed-success confirmation",
    "no bank otp": "No successful bank OTP API confirmation",
    "bank refused": "Bank API explicitly returned success=false",
    "response error": "Netcetera response contains error information",
}


@dataclass(frozen=True)
class Payment:
    """What sets a format apart: its classes, its events that are successes, errors and responses, and its warnings."""

    classes: tuple
    otherwise: str
    responses: tuple[str, ...]
    queued: tuple[str, ...]
    errors: tuple[str, ...]
    last_status: bool
    entity: str
    warnings: Callable[[], list[tuple[Column, str]]]
    #: What its messages say beside what all formats' do (names of SAID).
    says: tuple[str, ...] = ()
    #: Whether the last credential of a kind in a payload counts, not the first.
    last_credential: bool = False


#: What messages say outside of payloads, one group each.
SAID = {
    "msg_id": r"MsgId:\s*([A-Za-z0-9\-]+)",
    "queue": r"(?i)(?:Message for Queue\s*=\s*|\()(AFS\.[A-Za-z0-9._\-]+|[^\s()]*mq[^\s()]*)",
    "bank_org": r"(?i)\bBankOrg\s*[=:]\s*([A-Za-z0-9]+)",
    "oob_status": r"(?i)\bstatusResponseEnum\s*[=:]\s*([A-Z_]+)",
    "path_stepup_id": r"/(?:status|process/status)/([0-9a-fA-F\-]{36})",
    "customer_id": r"(?i)\bCustomerId\s*[=:]\s*([A-Za-z0-9\-]+)",
    "enable_oob": r"(?i)\bEnableOOB\s*[=:]\s*([YN])",
    "card_blocked": r"(?i)\bcardBlocked\s*[=:]\s*(true|false)",
    "response_code": r"(?i)\bResponseCode\s*[=:]\s*(\d+)",
    "error_call": r"Error in (.+?) Call : ",
    "error_url": r"Error in .+? Call : ([^\n]+)",
}
#: What a text holds, in lower case, where such a pattern can fit; it is tried on such texts alone.
SAID_SIGNS = {
    "msg_id": ("msgid:",),
    "queue": ("message for queue", "("),
    "bank_org": ("bankorg",),
    "oob_status": ("statusresponseenum",),
    "path_stepup_id": ("/status/",),
    "customer_id": ("customerid",),
    "enable_oob": ("enableoob",),
    "card_blocked": ("cardblocked",),
    "response_code": ("responsecode",),
    "error_call": (" call : ",),
    "error_url": (" call : ",),
}
#: The address that a bank's call goes to.
BANK_URL = r"(?i)(https?://[^\s<>\"']+)"


def read_events(rows: DataFrame, kind: Payment) -> DataFrame:
    """found_events(), written: messages are read once, and keys, merges and the join of entities go over what was found."""
    return written(found_events(rows, kind))


def found_events(rows: DataFrame, kind: Payment) -> DataFrame:
    """Classes, payloads and identifiers of events with file_name, ordinal, ts_raw, tracker, message, raw.

    For a single use: what it doesn't take is not looked for.
    """
    # One Python function reads all of a message, references, objects and XML.
    rows = rows.withColumn("p", payload("message")).withColumn("text", F.col("p.text"))
    rows = rows.withColumn("event_type", classify(F.col("text"), kind.classes, kind.otherwise))
    f = lambda key: F.try_element_at(F.col("p.fields"), F.lit(key))
    element = lambda name: F.try_element_at(F.col("p.tags"), F.lit(name.lower()))
    find = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    said = lambda n: F.when(contains_any(F.lower("text"), *SAID_SIGNS[n]), find(SAID[n]))
    key_of = lambda key: f"{key}:last" if kind.last_credential and key in ("@mobile", "@email") else key
    named = [F.coalesce(truthy(f(key_of(key))), *[truthy(element(t)) for t in tags]).alias(name) for name, key, tags in FIELDS]
    broken = F.col("p.status").isin("invalid", "incomplete")
    warnings = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("ts_raw"), F.lit("")) == "", WARNINGS["no time"]),
            F.when(F.col("tracker").isNull(), WARNINGS["no tracker"]),
            F.when(F.contains("text", F.lit("{")) & (F.size("p.objects") == 0), WARNINGS["no object"]),
            F.when(broken, WARNINGS["broken object"]),
            F.when(F.col("p.method") == "regex", WARNINGS["broken xml"]),
        )
    )
    return rows.select(
        "file_name",
        "ordinal",
        "ts_raw",
        "tracker",
        "message",
        "raw",
        "event_type",
        F.col("p.objects").alias("objects"),
        F.when(F.size("p.paths") > 0, F.col("p.paths")).alias("recovered"),
        F.col("p.method").alias("parse_method"),
        F.col("p.document").alias("document"),
        F.when(broken, "partial").otherwise("parsed").alias("parse_status"),
        warnings.alias("event_warnings"),
        exception(F.col("text")).alias("exception"),
        truthy(f("channel")).alias("channel"),
        operation(F.when(F.col("event_type") == "bank_api_url", find(BANK_URL))).alias("bank_operation"),
        truthy(f("transactionid")).alias("txid"),
        F.when(F.col("event_type").isin(*kind.responses), truthy(f("status"))).alias("status"),
        F.when(F.col("event_type").isin(*kind.responses), F.coalesce(truthy(f("description")), truthy(f("referencenumber")))).alias("error_text"),
        truthy(f("success")).alias("success"),
        *[said(n).alias(n) for n in ("msg_id", "queue", "bank_org", "oob_status", "path_stepup_id")],
        *[(said(n) if n in kind.says else F.lit(None).cast("string")).alias(n) for n in ("enable_oob", "response_code", "error_call", "error_url")],
        *[(F.coalesce(said(n), truthy(f(n.replace("_", "")))) if n in kind.says else F.lit(None).cast("string")).alias(n) for n in ("customer_id", "card_blocked")],
        otp_message(F.coalesce(base64_text(f("smsbody")), base64_text(f("message")))).alias("sms"),
        observables(F.col("text")).alias("observables"),
        *named,
    )


def merge(events: DataFrame, kind: Payment, key: str = "key") -> DataFrame:
    """The entities: events of a file with the same key, merged in their order. Partial merges run before the shuffle."""
    at = F.col("ordinal")
    name = F.col("event_type")
    status = (last_nonempty if kind.last_status else first_nonempty)(F.col("status"), at)
    sms_otp = F.coalesce(first_nonempty(F.col("otp"), at), first_nonempty(F.col("sms.otp"), at))
    merged = events.where(F.col(key).isNotNull()).groupBy("file_name", key).agg(
        first_nonempty(F.col("txid"), at).alias("transaction_id"),
        status.alias("status"),
        last_nonempty(F.col("error_text"), at).alias("error"),
        *[first_nonempty(F.col(n), at).alias(n) for n, _, _ in FIELDS if n != "otp"],
        sms_otp.alias("otp"),
        first_nonempty(F.col("bank_org"), at).alias("bank_org"),
        last_nonempty(F.col("queue"), at).alias("queue"),
        last_nonempty(F.col("msg_id"), at).alias("msg_id"),
        F.bool_or(name == "otp_success").alias("otp_processed"),
        F.bool_or(name.isin(*kind.queued)).alias("sms_queued"),
        F.bool_or(name == "force_verify_by_mobile").alias("force_verify_by_mobile"),
        first_nonempty(F.col("bank_operation"), at).alias("bank_operation"),
        first_nonempty(F.col("channel"), at).alias("channel"),
        F.max_by(F.lower("success"), F.when(name.isin("bank_api_success_response", "bank_api_error_response") & F.col("success").isNotNull(), at)).alias("bank_success"),
        ordered_distinct(F.col("tracker"), at).alias("trackers"),
        ordered_distinct(F.col("oob_status"), at).alias("oob_history"),
        ordered_distinct(F.lower("card_blocked"), at).alias("card_blocked_history"),
        *[first_nonempty(F.col(n), at).alias(n) for n in ("customer_id", "enable_oob", "response_code", "error_call", "error_url")],
        F.bool_or(name.isin(*kind.errors)).alias("has_errors"),
        F.min("ts_raw").alias("first_time"),
        F.max("ts_raw").alias("last_time"),
        F.count("*").alias("n_events"),
    )
    warnings = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in kind.warnings()]))
    done = merged.withColumn("warnings", warnings if kind.warnings() else F.array().cast("array<string>"))
    return done.withColumn("integrity_status", F.when(F.size("warnings") > 0, "CHECK").otherwise("OK"))


def _snapshot() -> Column:
    """The finished entity as it is attached to each of its events."""
    return F.struct(
        "transaction_id",
        "issuer_id",
        "processor_id",
        "stepup_request_id",
        "status",
        F.col("status").alias("stepup_status"),
        "error",
        F.struct(F.col("merchant_name").alias("name"), F.col("merchant_id").alias("id"), F.col("merchant_url").alias("url"), F.col("merchant_country").alias("country_code"), F.col("merchant_category").alias("category_code")).alias("merchant"),
        F.struct(F.col("amount_raw").alias("amount_raw"), F.col("amount_raw").try_cast("double").alias("amount"), "currency", F.col("tran_time").alias("timestamp")).alias("transaction"),
        F.struct("mobile", "email", "customer_id").alias("customer"),
        F.struct("card_number", "expiry_month", "expiry_year").alias("payment"),
        F.struct(F.col("auth_type").alias("type"), "status", "otp_processed", "sms_queued").alias("authentication"),
        F.struct(F.col("oob_history").alias("status_history"), F.col("enable_oob").alias("enabled"), F.transform("card_blocked_history", lambda x: x == "true").alias("card_blocked_history")).alias("oob"),
        F.struct("response_code").alias("vplus"),
        F.struct(F.col("bank_operation").alias("operation"), F.col("bank_success").cast("boolean").alias("success")).alias("bank_api"),
        F.struct(F.col("channel"), F.col("otp").alias("value"), F.col("otp_processed").alias("processed_successfully")).alias("otp"),
        F.struct(F.col("otp").alias("value"), F.col("otp_processed").alias("processed_successfully")).alias("otp_state"),
        "bank_org",
        "org",
        "queue",
        "msg_id",
        "otp_processed",
        "force_verify_by_mobile",
        _derived().alias("derived"),
        "trackers",
        "integrity_status",
        "warnings",
    )


def _derived() -> Column:
    """What an entity has; each flag is true or false, never null."""
    of = lambda step: F.coalesce(F.exists("trackers", lambda t: phase(t) == step), F.lit(False))
    success = F.coalesce(F.col("status") == "SUCCESS", F.lit(False)) | F.coalesce("otp_processed", F.lit(False))
    return F.struct(
        F.col("mobile").isNotNull().alias("has_sms"),
        F.col("email").isNotNull().alias("has_email"),
        of("STEP_UP").alias("has_stepup"),
        of("INITIATE_ACTION").alias("has_initiate_action"),
        success.alias("is_success"),
    )


def _with_entity(own: Column) -> Column:
    """An event's own JSON, which is never empty, with the member that its entity is."""
    return F.concat(F.left(own, F.length(own) - 1), F.coalesce(F.concat(F.lit(","), F.substring("entity", F.lit(2), F.length("entity"))), F.lit("}")))


def _action() -> Column:
    return F.coalesce(truthy(F.col("message")), F.lit("(no message)"))


def _emit(events: DataFrame, kind: Payment, correlation: Column, level: Column, head: Column | None = None) -> DataFrame:
    """Records of keyed events with their entity joined back, and what `head` says of it. Entities become JSON once, not for each of their events."""
    named = [head.alias("head")] if head is not None else []
    entities = merge(events, kind).select("file_name", "key", *named, F.to_json(F.struct(_snapshot().alias(kind.entity))).alias("entity"))
    joined = events.join(entities, ["file_name", "key"], "left")
    own = F.to_json(F.struct("event_type", "parse_status", F.col("tracker").alias("tracker_no"), phase(F.col("tracker")).alias("phase"), "msg_id", "queue", "objects", "recovered", "parse_method", "document", "exception", "error_call", "error_url", "response_code", F.col("event_warnings").alias("warnings"), "sms", "observables"))
    details = _with_entity(own)
    return joined.select("file_name", "ordinal", "ts_raw", level.alias("log_level"), correlation.alias("correlation_id"), F.col("event_type").alias("log_type"), _action().alias("action"), details.alias("details"), "raw")


def _tx_of_tracker(events: DataFrame) -> DataFrame:
    """The last transaction id that a tracker's own payloads name; it claims all of the tracker's events."""
    return events.where("txid IS NOT NULL AND tracker IS NOT NULL").groupBy("file_name", "tracker").agg(F.max_by("txid", "ordinal").alias("tracker_tx"))


def _tracked_lines(lines: DataFrame) -> DataFrame:
    return split_records(lines, TRACKED).select("file_name", "ordinal", F.regexp_extract("header", US_TIME, 0).alias("ts_raw"), F.upper(F.regexp_extract("header", r"(?i)Log Tracker No:\s*([A-Z]{2}\d+)", 1)).alias("tracker"), F.col("body").alias("message"), F.concat_ws(" ", clean(F.col("header")), "body").alias("raw"))


AFS = Payment(AFS_CLASSES, "other", ("netcetera_response",), ("sms_queue",), ("error",), True, "transaction", list, last_credential=True)


def afs_netcetera(lines: DataFrame) -> DataFrame:
    """Line by line; what doesn't fit becomes an "unparsed" WARN record without time, in no transaction."""
    own = rf"^({US_TIME})\s+Log Tracker No:\s+([A-Z]{{2}}\d+)\s+=>\s+(.*)$"
    rows = lines.select("file_name", F.col("line_no").alias("ordinal"), clean(F.col("line")).alias("raw")).where("raw <> ''").withColumn("fits", F.col("raw").rlike(own))
    part = lambda i: F.regexp_extract("raw", own, i)
    events = read_events(rows.where("fits").select("file_name", "ordinal", part(1).alias("ts_raw"), part(2).alias("tracker"), clean(part(3)).alias("message"), "raw"), AFS)
    keyed = events.join(_tx_of_tracker(events), ["file_name", "tracker"], "left").withColumn("key", F.col("tracker_tx"))
    done = _emit(keyed, AFS, F.coalesce("key", "tracker"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"))
    null = F.lit(None).cast("string")
    failed = rows.where("NOT fits").select("file_name", "ordinal", null.alias("ts_raw"), F.lit("WARN").alias("log_level"), null.alias("correlation_id"), F.lit("unparsed").alias("log_type"), F.lit("Line does not match log pattern").alias("action"), F.to_json(F.struct("raw", F.col("ordinal").alias("line_no"))).alias("details"), "raw")
    return done.unionByName(failed)


OTP = Payment(OTP_CLASSES, "other", (), ("sms_queue_msg_id",), (), True, "record", list)


def otp_processor(lines: DataFrame) -> DataFrame:
    """Events at timestamps anywhere; lines without a tracker take the pending one; updates count after the first XML of a tracker."""
    rows = split_records(lines, US_TIME, anywhere=True).withColumn("message", clean(F.regexp_replace("body", r"^\s*:\s*", "")))
    plain = unescape_all(F.col("message"))
    rows = rows.withColumn("plain", plain)
    own = F.coalesce(
        F.nullif(F.upper(F.regexp_extract("plain", r"(?i)Log Tracker No:\s*([A-Z]{2}\d+)", 1)), F.lit("")),
        F.nullif(clean(F.regexp_extract("plain", r"(?is)<mtrackingid>(.*?)</mtrackingid>", 1)), F.lit("")),
    )
    base = rows.select("file_name", "ordinal", F.col("header").alias("ts_raw"), own.alias("own"), "message", F.concat_ws(" ", "header", "message").alias("raw")).withColumn("tracker", F.col("own"))
    events = read_events(base, OTP).withColumn("own", F.col("tracker"))
    name = F.col("event_type")
    sms = name.isin("msg_received_sms_xml", "sms_input_xml")
    sets = F.when(sms & F.col("own").isNotNull(), F.col("own")).when(name.isin("sms_queue_msg_id", "otp_success", "force_verify_by_mobile"), F.col("own"))
    events = carried(events, "pending", sets, "ordinal", within=("file_name",), before=True)
    events = events.withColumn("tracker", F.when(name == "other", F.col("own")).otherwise(F.coalesce("own", "pending")))
    begun = events.where(sms & F.col("own").isNotNull()).groupBy("file_name", F.col("own").alias("tracker")).agg(F.min("ordinal").alias("begun"))
    keyed = events.join(begun, ["file_name", "tracker"], "left").withColumn("late", F.col("ordinal") < F.col("begun"))
    # An update that comes before its record's first XML reaches no record, but shows the finished one.
    reach = keyed.withColumn("key", F.when(F.col("begun").isNotNull() & ~F.col("late"), F.col("tracker")))
    entities = merge(reach, OTP).select("file_name", F.col("key").alias("tracker"), F.to_json(F.struct(_snapshot().alias(OTP.entity))).alias("entity"))
    joined = keyed.join(entities, ["file_name", "tracker"], "left")
    failed = sms & F.col("own").isNull()
    own_json = F.to_json(F.struct("event_type", F.col("tracker").alias("tracker_no"), "queue", "msg_id", F.when(failed, WARNINGS["no tracker in xml"]).alias("parse_error"), "parse_method", "document", "exception", F.col("event_warnings").alias("warnings")))
    details = _with_entity(own_json)
    level = F.when((name == "other") | failed, "WARN").otherwise("INFO")
    return joined.select("file_name", "ordinal", "ts_raw", level.alias("log_level"), F.col("tracker").alias("correlation_id"), name.alias("log_type"), _action().alias("action"), details.alias("details"), "raw")


def _debit_warnings() -> list[tuple[Column, str]]:
    return [(F.col("transaction_id").isNull(), "No TransactionId"), (F.size("trackers") == 0, "No tracker"), (F.col("status").isNull() & ~F.col("otp_processed"), "No final status or processed OTP"), (F.col("has_errors"), "One or more errors")]


DEBIT = Payment(DEBIT_CLASSES, "message", ("netcetera_response_json", "debit_response_json", "debit_request_json"), ("queue", "queue_msg_id"), ("error",), False, "transaction", _debit_warnings, says=("error_call", "error_url"))


def debit_portal(lines: DataFrame) -> DataFrame:
    """Trackers carry forward; the key is a transaction id, else the tracker's, else the tracker, else the event alone."""
    rows = split_records(lines, US_TIME, anywhere=True).withColumn("message", clean(F.regexp_replace("body", r"^\s*(?:->|:)\s*", "")))
    own = F.nullif(F.upper(F.regexp_extract("message", r"(?i)Log Tracker No:\s*([A-Z]{2}\d+)", 1)), F.lit(""))
    events = read_events(rows.select("file_name", "ordinal", F.col("header").alias("ts_raw"), own.alias("tracker"), "message", F.concat_ws(" ", "header", "message").alias("raw")), DEBIT)
    known = _tx_of_tracker(events).select("file_name", F.col("tracker").alias("effective"), F.col("tracker_tx").alias("effective_tx"))
    keyed = carried(events, "effective", F.col("tracker"), "ordinal", within=("file_name",)).join(known, ["file_name", "effective"], "left").withColumn("key", F.coalesce("txid", "effective_tx", F.concat(F.lit("tracker:"), "effective"), F.concat(F.lit("event_"), "ordinal")))
    level = F.when(F.col("parse_status") == "partial", "WARN").when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return _emit(keyed, DEBIT, F.coalesce("txid", "effective_tx", "tracker"), level)


def _cardinal_warnings() -> list[tuple[Column, str]]:
    otp = F.coalesce(F.upper("auth_type") == "OTP", F.lit(False))
    return [
        (F.col("transaction_id").isNull(), WARNINGS["flow without transaction"]),
        (F.size("trackers") == 0, WARNINGS["flow without tracker"]),
        (otp & ~F.col("sms_queued"), WARNINGS["otp without queue"]),
        (otp & ~F.col("otp_processed"), WARNINGS["otp without success"]),
        (F.try_element_at("oob_history", F.lit(-1)) == "PENDING", WARNINGS["oob pending"]),
        (F.col("has_errors"), WARNINGS["flow with errors"]),
    ]


CARDINAL_ERRORS = ("vplus_mq_timeout", "oob_http_error", "web_exception", "oob_validate_exception", "oob_empty_status_response", "oob_status_api_error", "error")
CARDINAL = Payment(CARDINAL_CLASSES, "message", ("cardinal_stepup_response", "cardinal_validate_response"), ("otp_queue",), CARDINAL_ERRORS, True, "flow", _cardinal_warnings, says=("customer_id", "enable_oob", "card_blocked", "response_code"))


def cardinal(lines: DataFrame) -> DataFrame:
    """Flows by aliases: transaction id, step-up ids, tracker. Stack traces and other lines belong to their event."""
    events = read_events(_tracked_lines(lines), CARDINAL)
    alias = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind}:"), c))
    events = events.withColumn("aliases", F.array_compact(F.array(alias("tx", "txid"), alias("stepup", "stepup_request_id"), alias("stepup", "path_stepup_id"), alias("tracker", "tracker"))))
    # Written, as entities and events both take their flow from it.
    flows = written(resolve_aliases(events, "file_name").withColumnRenamed("flow", "key"))
    keyed = events.join(flows, ["file_name", "ordinal"], "left")
    head = F.coalesce("transaction_id", "stepup_request_id", F.get("trackers", F.lit(0)))
    lower = F.lower("message")
    level = F.when(F.col("event_type").isin(*CARDINAL_ERRORS) | lower.rlike(r'"?status"\s*:\s*"error"|mq timeout|host unreachable'), "ERROR").otherwise("INFO")
    return _emit(keyed, CARDINAL, F.coalesce("head", "tracker"), level, head)


def _vflex_warnings() -> list[tuple[Column, str]]:
    step = phase(F.get("trackers", F.lit(0)))
    up, act = step == "STEP_UP", step == "INITIATE_ACTION"
    confirmed = F.coalesce(F.col("bank_success") == "true", F.lit(False))
    return [
        (up & F.col("transaction_id").isNull(), WARNINGS["step-up without transaction"]),
        (up & ~confirmed, WARNINGS["step-up without bank"]),
        (up & (F.coalesce("status", F.lit("")) != "SUCCESS"), WARNINGS["step-up without response"]),
        (act & F.col("otp").isNull(), WARNINGS["no otp"]),
        (act & ~F.col("sms_queued"), WARNINGS["no queue"]),
        (act & ~F.col("otp_processed"), WARNINGS["no success"]),
        (act & ~confirmed, WARNINGS["no bank otp"]),
        (F.col("bank_success") == "false", WARNINGS["bank refused"]),
        (F.col("error").isNotNull(), WARNINGS["response error"]),
    ]


VFLEX = Payment(VFLEX_CLASSES, "message", ("netcetera_stepup_response",), ("sms_queue",), ("error", "bank_api_error_response"), True, "transaction", _vflex_warnings)


def _vflex_messages(lines: DataFrame) -> DataFrame:
    rows = split_records(lines.withColumn("line", plain_signs(F.col("line"))), US_TIME)
    own = F.nullif(F.upper(F.regexp_extract("body", r"(?i)\b((?:SU|IA|VL)\d+)\b", 1)), F.lit(""))
    message = clean(F.regexp_replace("body", r"(?i)^\s*(?::\s*)?(?:Log Tracker No:\s*[A-Z]{2}\d+\s*(?:=>|=\\>|=&gt;))?\s*", ""))
    return rows.select("file_name", "ordinal", clean(F.col("header")).alias("ts_raw"), own.alias("tracker"), message.alias("message"), F.concat_ws(" ", "header", "body").alias("raw"))


def _vflex_level() -> Column:
    return F.when(F.col("event_type").isin("error", "bank_api_error_response") | F.col("message").rlike(ERROR_WORD), "ERROR").otherwise("INFO")


def vflex(lines: DataFrame) -> DataFrame:
    """Events by their own tracker; events without one stay alone."""
    keyed = read_events(_vflex_messages(lines), VFLEX).withColumn("key", F.col("tracker"))
    return _emit(keyed, VFLEX, F.coalesce("head", "tracker"), _vflex_level(), F.col("transaction_id"))


def vflex_events(lines: DataFrame) -> DataFrame:
    """The same events with log_level and action, but without entities and documents: for what an event says by itself."""
    return found_events(_vflex_messages(lines), VFLEX).withColumns({"log_level": _vflex_level(), "action": _action()})


def _says(*parts: str, header: str = US_TIME) -> Callable[[str], bool]:
    return lambda text: bool(re.search(header, text)) and any(p in text.lower() for p in parts)


def _is_debit(text: str) -> bool:
    low = text.lower()
    marked = ("debit" in low and ("request" in low or "response" in low)) or "postilion" in low or "postailion" in low
    return bool(re.search(US_TIME, text)) and (marked or bool(re.search(r"Log Tracker No:\s*[A-Z]{2}\d+", text)))


FORMATS = (
    Format("afs_netcetera", "AFS / Netcetera 3DS StepUp (Transaction Correlation)", "afs_netcetera_3ds_stepup", lambda t: bool(re.search(rf"^{US_TIME}\s+Log Tracker No:\s+[A-Z]{{2}}\d+\s+=>\s+", t, re.M)), afs_netcetera),
    Format("otp_processor", "OTP Online Processor (SMS/Email XML)", "otp_online_processor", _says("msg received--", "message for queue=", "otp processed successfully", "force verify by mob", "sms placed in queue"), otp_processor),
    Format("debit_portal_log", "Debit Portal Log (Transactions + Errors)", "debit_portal_log", _is_debit, debit_portal),
    Format("cardinal", "Cardinal OTP/StepUp/OOB Log (Multi-Flow Correlation)", "cardinal_stepup_oob_log", _says("cardinal", "oob tracker id", "invokeoobapiget", "/process/status/", "/process/validate", "/process/authenticate", "out-of-band", header=TRACKED), cardinal),
    Format("vflex", "VFlex StepUp/Bank API/OTP Log (Transaction Correlation)", "vflex_transaction_log", _says("stepupcall vf input message", "get data from bank payload", "bank api url", "success response from bank api call", "error response from bank api call", "sql connection established success"), vflex),
)
