"""Older forms of the portal logs, with retries, calls, responses and ends of requests.

Their files can't be told from those of the present forms, so they are read only where they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import clean, contains_any, mask, parameters
from emberlog.operators.formats import RECORD, US_TIME, Format, classify, split_records
from emberlog.operators.formats.portals import ISO_TIME, TRACKER, xml_details

#: How these forms write retries, calls, responses, calls' names and arguments, and what they mask.
RETRY = r"mqRetry\s*:?\s*(\d+)"
CALLING = r"Calling Method\s*:\s*\{([^}]*)\}"
CREDIT_CALL = r"(?s)(\w+)\s*\((.*?)\)"
MIDDLEWARE_CALL = r"(?s)Inputs\s*:\s*(\w+)?\s*\((.*?)\)"
UNIFIED_CALL = r"(?s)(?:Inputs\s*:?\s*-?\s*Data\s+in\s+)?(\w+)?\s*\((.*?)\)"
UNIFIED_TRACKER = "(?s)(?:Log Tracker No:\\s*([^\\s=>]+)|([\\d—-]+?)(?:---|—))\\s*(?:=>)?\\s*(.*)"
MASKED = ("pcinumber", "cif", "email", "user", "psw")
ERRORS = ("exception", "error", "failed", "timeout", "fault")
FIRST_WORD = r"^(\w+)"


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda text: contains_any(text, *parts)


def _calls(text: Column) -> Column:
    return F.contains(text, F.lit("Inputs")) & F.contains(text, F.lit("(")) & F.contains(text, F.lit(")"))


def _warns(text: Column) -> Column:
    return F.contains(text, F.lit("Warrning")) | F.contains(F.lower(text), F.lit("warning"))


#: Classes in order, the first that holds counts.
CREDIT_KINDS = (
    ("XML_PAYLOAD", _holds("<?xml", "<Iso8583PostXml")),
    ("FUNCTION_INPUT", _calls),
    ("FUNCTION_RESPONSE", _holds("VP_Response:")),
    ("REQUEST_END", lambda text: text.rlike("(?i)End of request")),
    ("WARNING", _warns),
)
MIDDLEWARE_KINDS = (
    ("XML_PAYLOAD", _holds("<?xml", "PostXml>", "<Iso")),
    ("FUNCTION_INPUT", _calls),
    ("FUNCTION_RESPONSE", _holds("VP_Response", "Response:")),
    ("WARNING", _warns),
    ("ERROR", lambda text: contains_any(F.lower(text), *ERRORS)),
)
UNIFIED_KINDS = (
    ("XML_PAYLOAD", _holds("<?xml", "PostXml>")),
    ("FUNCTION_INPUT", _calls),
    ("RESPONSE_PAYLOAD", lambda text: contains_any(text, "mqRetry:", "VP_Response:") | F.startswith(text, F.lit("CC_"))),
    ("WARNING", _warns),
)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _xml_at(text: Column) -> Column:
    """Where XML begins, from 1; null where neither a declaration nor a message does."""
    return F.coalesce(F.nullif(F.instr(text, "<?xml"), F.lit(0)), F.nullif(F.instr(text, "<Iso"), F.lit(0)))


def _before_xml(text: Column) -> Column:
    at = _xml_at(text)
    return F.when(at.isNull(), "XML API Request").otherwise(F.trim(F.substring(text, F.lit(1), at - 1), F.lit(" :-")))


def _from_xml(text: Column, lenient: bool, keep: bool = False) -> Column:
    return xml_details(F.substring(text, F.coalesce(_xml_at(text), F.lit(1)), F.length(text)), lenient, keep)


def _arguments(text: Column, call: str, masked: bool = False) -> Column:
    found = parameters(F.regexp_extract(text, call, 2))
    if masked:
        hide = lambda key, value: F.when(F.lower(key).isin(*MASKED) & (F.length(value) > 8), mask(value)).otherwise(value)
        found = F.transform_values(found, hide)
    return F.when(text.rlike(call), F.to_json(F.struct(found.alias("parameters")))).otherwise("{}")


def _tracked(rows: DataFrame) -> DataFrame:
    tracked = F.col("body").rlike(TRACKER)
    content = F.when(tracked, F.regexp_extract("body", TRACKER, 2)).otherwise(F.col("body"))
    return rows.withColumn("correlation_id", _found(F.col("body"), TRACKER)).withColumn("c", clean(content))


def _shaped(rows: DataFrame, stamp: str, kinds, otherwise: str, actions: dict[str, Column], details: dict[str, Column], level: Column, **more: Column) -> DataFrame:
    """Records by class: the action is the content, and the details are empty, where nothing is given for a class."""
    kind = F.col("log_type")
    action, detail = F.col("c"), F.lit("{}")
    for name, value in actions.items():
        action = F.when(kind == name, value).otherwise(action)
    for name, value in details.items():
        detail = F.when(kind == name, value).otherwise(detail)
    classed = rows.withColumn("log_type", classify(F.col("c"), kinds, otherwise)).withColumn("ts_raw", F.regexp_extract("header", stamp, 0))
    done = classed.withColumns({"log_level": level, "action": action, "details": detail, "raw": F.concat(clean(F.col("header")), F.lit(" "), "body"), **more})
    return done.select(*RECORD, *more)


def abce_credit(lines: DataFrame) -> DataFrame:
    """Records open where a time and a tracker stand at a line's start; what comes before the first is dropped."""
    c = F.col("c")
    word = _found(c, FIRST_WORD)
    rows = _tracked(split_records(lines, rf"{US_TIME}\s+(?=Log Tracker No:)"))
    response = F.to_json(F.struct(clean(F.regexp_extract(c, r"(?s)VP_Response:(.*)", 1)).alias("response")))
    return _shaped(
        rows, US_TIME, CREDIT_KINDS, "GENERIC",
        {"XML_PAYLOAD": _before_xml(c), "FUNCTION_INPUT": _found(c, CREDIT_CALL), "FUNCTION_RESPONSE": word, "REQUEST_END": word},
        {"XML_PAYLOAD": _from_xml(c, lenient=False), "FUNCTION_INPUT": _arguments(c, CREDIT_CALL, masked=True), "FUNCTION_RESPONSE": response},
        F.lit(None).cast("string"),
        retry_count=_found(c, RETRY).cast("int"),
        calling_method=clean(_found(c, CALLING)),
    )


def asbb_mw_credit(lines: DataFrame) -> DataFrame:
    """Records open anywhere in a line. XML is kept beside its fields, and a line that speaks of errors is an ERROR."""
    c = F.col("c")
    word = _found(c, FIRST_WORD)
    rows = _tracked(split_records(lines, rf"{ISO_TIME}\s+\[[A-Z]+\]\s*", anywhere=True))
    called = F.when(c.rlike(MIDDLEWARE_CALL), F.coalesce(_found(c, MIDDLEWARE_CALL), F.lit("Inputs"))).otherwise(c)
    return _shaped(
        rows, ISO_TIME, MIDDLEWARE_KINDS, "GENERIC",
        {"XML_PAYLOAD": _before_xml(c), "FUNCTION_INPUT": called, "FUNCTION_RESPONSE": F.coalesce(word, F.lit("Response")), "GENERIC": F.coalesce(word, c)},
        {"XML_PAYLOAD": _from_xml(c, lenient=True, keep=True), "FUNCTION_INPUT": _arguments(c, MIDDLEWARE_CALL), "FUNCTION_RESPONSE": F.to_json(F.struct(c.alias("response")))},
        F.regexp_extract("header", r"\[([A-Z]+)\]", 1),
        retry_count=_found(c, rf"(?i){RETRY}").cast("int"),
    )


def unified(lines: DataFrame) -> DataFrame:
    """Portal logs of both kinds: a file that holds an ISO time anywhere is read by these, all others by US times.

    Rows of dashes under US times are no records. One row for each file tells which kind it is.
    """
    c = F.col("c")
    is_iso = F.coalesce(F.col("line").rlike(r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"), F.lit(False))
    iso_files = lines.groupBy("file_name").agg(F.max(is_iso).alias("iso")).where("iso").select("file_name")
    iso = split_records(lines.join(iso_files, "file_name", "left_semi"), rf"{ISO_TIME}\s+\[[A-Z]+\]\s*", anywhere=True)
    us = split_records(lines.join(iso_files, "file_name", "left_anti"), rf"{US_TIME}\s+(?:->|=>)?").where(~F.col("body").rlike("^-+$"))
    body = F.col("body")
    tracked = body.rlike(UNIFIED_TRACKER)
    own = F.coalesce(_found(body, UNIFIED_TRACKER, 1), _found(body, UNIFIED_TRACKER, 2))
    rows = iso.unionByName(us).withColumn("correlation_id", F.nullif(F.regexp_replace(own, r"[—\s-]", ""), F.lit("")))
    rows = rows.withColumn("c", clean(F.when(tracked, F.regexp_extract(body, UNIFIED_TRACKER, 3)).otherwise(body)))
    called = F.when(c.rlike(UNIFIED_CALL), F.coalesce(_found(c, UNIFIED_CALL), F.lit("Inputs"))).otherwise(c)
    answer = F.to_json(F.struct(_found(c, r"mqRetry:(\d+)").alias("mq_retry"), _found(c, r"VP_Response:(\d+)").alias("vp_response")))
    return _shaped(
        rows, rf"{ISO_TIME}|{US_TIME}", UNIFIED_KINDS, "INFO",
        {"XML_PAYLOAD": _before_xml(c), "FUNCTION_INPUT": called, "RESPONSE_PAYLOAD": F.coalesce(_found(c, FIRST_WORD), F.lit("Response"))},
        {"XML_PAYLOAD": _from_xml(c, lenient=True), "FUNCTION_INPUT": _arguments(c, UNIFIED_CALL), "RESPONSE_PAYLOAD": answer},
        F.coalesce(_found(F.col("header"), r"\[([A-Z]+)\]"), F.lit("INFO")),
    )


def by_transaction(records: DataFrame) -> DataFrame:
    """Records with the number of records of their transaction; those without an id are one transaction of that name.

    Counts are joined back, so that no transaction is gathered in one row or task, however many records it has.
    """
    named = records.withColumn("correlation_id", F.coalesce("correlation_id", F.lit("NO_CORRELATION_ID")))
    return named.join(named.groupBy("correlation_id").agg(F.count("*").alias("event_count")), "correlation_id")


def _never(text: str) -> bool:
    return False


#: Source systems.
FORMATS = (
    Format("abce_credit_older", "ABCE Credit Portal (older form)", "abce_credit_portal", _never, abce_credit),
    Format("asbb_mw_credit_older", "ASBB MW Credit Portal (older form)", "asbb_mw_credit_portal", _never, asbb_mw_credit),
    Format("unified_portal", "Portal logs of both kinds (prototype)", "unified_portal", _never, unified),
)
