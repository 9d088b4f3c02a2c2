"""Portal logs: a timestamp, a correlation id, then XML, function inputs, a warning, or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import clean, contains_any, pairs_of, parameters
from emberlog.operators.formats import US_TIME, Format, multiline, split_records

#: How records of these portals begin, what names them, and how inputs are written.
ISO_TIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\s+[+\-]\d{2}:\d{2}"


def xml_details(xml: Column, lenient: bool, keep: bool = False) -> Column:
    """msg_type and a map of the fields; broken XML by its tags if lenient, else as it is. The XML stays beside them if keep."""
    broken = F.from_xml(xml, "MsgType string, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    inside = F.regexp_extract(xml, r"(?s)<Fields>(.*)</Fields>", 1)
    message_type = F.nullif(F.regexp_extract(xml, r"<MsgType>(.*?)</MsgType>", 1), F.lit("")).alias("msg_type")
    source = [xml.alias("raw_xml")] if keep else []
    whole = F.to_json(F.struct(message_type, pairs_of(inside, r"(?s)<([A-Za-z0-9_]+)>(.*?)</\1>", False).alias("fields"), *source))
    if lenient:
        by_tags = pairs_of(xml, r"(?s)<([A-Za-z0-9_]+)>(.*?)</[A-Za-z0-9_]+>")
        rest = F.to_json(F.struct(message_type, by_tags.alias("fields"), *source))
    else:
        rest = F.to_json(F.struct(xml.alias("raw_xml")))
    return F.when(broken, rest).otherwise(whole)


def _records(
    lines: DataFrame,
    header: str,
    stamp: str,
    arrow: bool,
    correlate: str,
    inputs: str,
    lenient: bool,
    level: bool = False,
    dividers: bool = False,
    steps: bool = False,
    anywhere: bool = False,
    default_action: str | None = None,
) -> DataFrame:
    """Records by class, with what a class tells: XML's fields, or a call's name and parameters."""
    kept = lines.where(~F.col("line").rlike(rf"^{header}\s*-+\s*$")) if dividers else lines
    rows = split_records(kept, header, anywhere).withColumn("ts_raw", F.regexp_extract("header", stamp, 0))
    own, fits = F.regexp_extract("body", correlate, 1), F.col("body").rlike(correlate)
    plain_id = F.regexp_replace(own, r"[—\s]" + ("|-" if arrow else ""), "")
    content = clean(F.when(fits, F.regexp_extract("body", correlate, 2)).otherwise(F.col("body")))
    rows = rows.withColumn("correlation_id", F.nullif(F.when(fits, plain_id), F.lit(""))).withColumn("c", content)

    c = F.col("c")
    has_xml = contains_any(c, "<?xml", "PostXml>")
    if arrow:
        has_inputs = F.contains(c, F.lit("Inputs in "))
    else:
        has_inputs = F.contains(c, F.lit("Inputs")) & F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))
    warns = F.contains(F.lower(c), F.lit("warning")) | F.contains(c, F.lit("Warrning"))
    kind = F.when(has_xml, "XML_PAYLOAD").when(has_inputs, "FUNCTION_INPUT").when(warns, "WARNING")
    if steps:
        kind = kind.when(F.contains(c, F.lit("New Request")), "STEP_EVENT")

    at = F.coalesce(F.nullif(F.instr(c, "<?xml"), F.lit(0)), F.nullif(F.instr(c, "<Iso"), F.lit(0)), F.lit(1))
    called = c.rlike(inputs)
    name = clean(F.regexp_extract(c, inputs, 1))
    if default_action:
        name = F.coalesce(F.nullif(name, F.lit("")), F.lit(default_action))
    before_xml = F.trim(F.substring(c, F.lit(1), at - 1), F.lit(" :-"))
    call = F.when(called, name).otherwise(F.lit(None) if arrow else c)
    given = F.to_json(F.struct(parameters(F.regexp_extract(c, inputs, 2)).alias("parameters")))
    from_xml = xml_details(F.substring(c, at, F.length(c)), lenient)
    if level:
        raw = F.concat(clean(F.col("header")), F.lit(" "), "body")
        log_level = F.regexp_extract("header", r"\[([A-Z]+)\]", 1)
    else:
        raw = F.concat("ts_raw", F.lit(" -> " if arrow else " "), "body")
        log_level = F.lit(None).cast("string")
    return rows.select(
        "file_name",
        "ordinal",
        "ts_raw",
        log_level.alias("log_level"),
        "correlation_id",
        kind.otherwise("INFO").alias("log_type"),
        F.when(has_xml, before_xml).when(has_inputs, call).otherwise(c).alias("action"),
        F.when(has_xml, from_xml).when(has_inputs & called, given).otherwise("{}").alias("details"),
        raw.alias("raw"),
    )


TRACKER = r"(?s)^Log Tracker No:\s*([^\s=>]+)\s*=>\s*(.*)"
ARROW = rf"{US_TIME}\s*->"


def abce_credit(lines: DataFrame) -> DataFrame:
    return _records(lines, rf"{US_TIME}\s+", US_TIME, False, TRACKER, r"(?s)(?:Inputs(?:-:\s*Data\s+in)?\s+)?(\w+)\s*\((.*?)\)", False)


def asbb_mw_credit(lines: DataFrame) -> DataFrame:
    return _records(lines, rf"{ISO_TIME}\s+\[[A-Z]+\]\s*", ISO_TIME, False, TRACKER, r"(?s)Inputs\s*:\s*(\w+)?\s*\((.*?)\)", True, level=True, anywhere=True, default_action="Inputs")


def abce_debit(lines: DataFrame) -> DataFrame:
    return _records(lines, ARROW, US_TIME, True, "(?s)^([\\d—-]+?)(?:---|—)\\s*(.*)", r"(?s)Inputs in ([^(]+)\((.*)\)", True, dividers=True, steps=True)


def asbb_debit(lines: DataFrame) -> DataFrame:
    return _records(lines, ARROW, US_TIME, True, r"(?s)^(\d+)---(.*)", r"(?s)^Inputs in ([^(]+)\((.*)\)", False)


#: Display names and source systems.
FORMATS = (
    Format("abce_credit", "ABCE Credit Portal (Log Tracker / ISO8583 XML)", "abce_credit_portal", lambda t: multiline(rf"^{US_TIME}(?!\s*->)")(t) and "Log Tracker No:" in t, abce_credit),
    Format("asbb_mw_credit", "ASBB MW Credit Portal (ISO Timestamp + Log Tracker)", "asbb_mw_credit_portal", multiline(rf"^{ISO_TIME}\s+\[[A-Z]+\]"), asbb_mw_credit),
    Format("abce_debit", "ABCE Debit Portal (Correlation ID + Arrow Timestamp)", "abce_debit_portal", multiline(rf"^{ARROW}"), abce_debit),
    Format("asbb_debit", "ASBB Debit Portal (Correlation ID + Arrow Timestamp)", "asbb_debit_portal", multiline(rf"^{ARROW}"), asbb_debit),
)
