"""Timestamps of log lines as Column expressions.

A fixed ladder of formats instead of guessing: what a text means never depends on the day it is read. What no rung
takes can go through `fuzzy`, an Arrow function, with the ingestion day as the default date.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.once import once

#: Rungs: what a text looks like, and the formats that such a text may have. A format that doesn't fit costs an exception
#: inside Spark, so only formats of the text's own shape are tried. ISO texts are cast, which costs none.
ZONED = (
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:", ("dd/MMM/yyyy:HH:mm:ss Z",)),
    (r"^\d{4}-\d{2}-\d{2} .*\.", ("yyyy-MM-dd HH:mm:ss.SSS Z",)),
    (r"^\d{4}-\d{2}-\d{2} ", ("yyyy-MM-dd HH:mm:ss Z",)),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} ", ("d MMM yyyy HH:mm:ss Z",)),
)
LOCAL = (
    (r"^\d{4}-\d{2}-\d{2}$", ("yyyy-MM-dd",)),
    (r"^\d{4}-\d{2}-\d{2} .*,\d+$", ("yyyy-MM-dd HH:mm:ss,SSS",)),
    (r"^\d{4}/\d{2}/\d{2} ", ("yyyy/MM/dd HH:mm:ss",)),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} .*[ap]m$", ("M/d/yyyy h:mm:ss a",)),
    (r"^\d{1,2}/\d{1,2}/\d{4} ", ("M/d/yyyy HH:mm:ss",)),
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:", ("dd/MMM/yyyy:HH:mm:ss",)),
    (r"^[A-Za-z]{3} \d{1,2} [\d:]+\.\d+ \d{4}$", ("MMM d HH:mm:ss.SSSSSS yyyy",)),
    (r"^[A-Za-z]{3} \d{1,2} [\d:]+ \d{4}$", ("MMM d HH:mm:ss yyyy",)),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} ", ("d MMM yyyy HH:mm:ss",)),
)
#: Dates without a year take that of the ingestion.
SYSLOG = r"^[A-Za-z]{3} \d{1,2} [\d:]+$"
#: Directives of strptime and the letters that mean the same here.
_STRPTIME = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "", "%y": "yy", "%z": "Z", "%j": "D"}


def from_strptime(fmt: str) -> str:
    """A strptime format as a datetime pattern; literal letters are quoted."""
    parts = re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", fmt)
    return "".join(_STRPTIME.get(p, "") if p[0] == "%" else f"'{p}'" if p.isalpha() else p for p in parts).strip()


@F.pandas_udf(T.TimestampType())
def fuzzy(raw: pd.Series, default: pd.Series) -> pd.Series:
    """A lenient reading of what no rung takes; null where there is none. Offsets are applied, results are UTC."""
    from dateutil import parser, tz

    def read(text: str | None, day: pd.Timestamp):
        try:
            found = parser.parse(text, fuzzy=True, default=day.to_pydatetime().replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None))
            return found.astimezone(tz.UTC).replace(tzinfo=None) if found.tzinfo else found
        except (ValueError, OverflowError, TypeError, AttributeError):
            return None

    return pd.Series([read(a, b) for a, b in zip(raw, default)], dtype="datetime64[ns]")


def parse_time(raw: Column, ingested: Column, zone: str | None = "UTC", fmt: str | None = None, lenient: bool = False) -> Column:
    """Struct of ts (to the second, ingestion time where nothing else is known) and confidence.

    parsed: the text has an offset, or the profile a zone; assumed_utc: neither; unparseable: no rung takes the text.
    """
    # A weekday adds nothing to a date.
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\s+", " "), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    known = bool(zone) and _is_zone(zone)

    def in_zone(ts: Column) -> Column:
        return F.to_utc_timestamp(ts, zone) if known else ts

    def rungs(text: Column, steps) -> Column:
        out = F.when(text.rlike(SYSLOG), F.try_to_timestamp(F.concat_ws(" ", F.date_format(ingested, "yyyy"), text), F.lit("yyyy MMM d HH:mm:ss")))
        for shape, formats in steps:
            out = out.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.expr("CAST(NULL AS TIMESTAMP)")))
        return out

    def local(text: Column) -> Column:
        own = [F.try_to_timestamp(text, F.lit(from_strptime(fmt)))] if fmt else []
        return in_zone(F.coalesce(*own, _iso(text), rungs(text, LOCAL)))

    def read(text: Column) -> Column:
        has_zone = text.rlike(r"(?i)([+-]\d{2}:?\d{2}|Z|UTC|GMT)$") & text.rlike(r"\d{1,2}:\d{2}")
        zoned = F.when(has_zone, F.coalesce(_iso(text), rungs(text, ZONED)))
        found = F.when(text != "", F.struct(text.alias("text"), zoned.alias("zoned")))
        return once(found, lambda x: F.struct(x["zoned"].alias("zoned"), F.when(x["zoned"].isNull(), local(x["text"])).alias("local")))

    def judge(x: Column) -> Column:
        ts = F.coalesce(x["zoned"], x["local"])
        confidence = F.when(ts.isNull(), "unparseable").when(x["zoned"].isNotNull(), "parsed").otherwise("parsed" if known else "assumed_utc")
        return F.struct(F.date_trunc("second", F.coalesce(ts, ingested)).alias("ts"), confidence.alias("confidence"))

    found = once(text, read)
    if lenient:  # a Python function can't stand inside the lambda
        found = F.when(found.isNotNull(), F.struct(found["zoned"].alias("zoned"), F.coalesce(found["local"], in_zone(fuzzy(raw, ingested))).alias("local")))
    return once(found, judge)


def _iso(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.regexp_replace(text, r"(\d{2}[.,]?\d*) ([+-]\d{2}:?\d{2})$", "$1$2")).try_cast("timestamp")


def _is_zone(name: str) -> bool:
    from zoneinfo import ZoneInfo

    try:
        ZoneInfo(name)
        return True
    except (KeyError, ValueError):
        return False


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null where the end lies before it, which is no duration."""
    ms = (F.unix_millis(end) - F.unix_millis(start)).cast("double")
    return F.when(ms >= 0, ms)


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")
