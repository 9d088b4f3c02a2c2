"""Formats with parsers of their own: lines to records, and what they share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import normalize_level
from emberlog.functions.text import clean
from emberlog.functions.times import parse_time
from emberlog.session import written
from emberlog.sources.files import BLOCK_LINES

#: Fixed value: the timestamp of most of these formats.
US_TIME = r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s+[AP]M"
RECORD = ("file_name", "ordinal", "ts_raw", "log_level", "correlation_id", "log_type", "action", "details", "raw")


@dataclass(frozen=True)
class Format:
    """A format: whether a bounded sample of text is one, and its records from numbered lines."""

    key: str
    name: str
    source_system: str
    detect: Callable[[str], bool]
    records: Callable[[DataFrame], DataFrame]


def split_records(lines: DataFrame, header: str, anywhere: bool = False) -> DataFrame:
    """file_name, ordinal, header, body: text from each match of header, at a line's start or anywhere, up to the next.

    What comes before a file's first match is dropped. A record is one row. Each block is cut into its records by itself and
    written, so lines are read and shuffled once; the last record of a block is joined with what the next ones begin with.
    """
    block = F.col("block") if "block" in lines.columns else F.floor(F.col("line_no") / BLOCK_LINES)
    rows = lines.select("file_name", block.alias("block"), "line_no", "line")
    if anywhere:
        pieces = F.filter(F.split("line", f"(?={header})"), lambda x: x != "")
        rows = rows.select(*[c for c in rows.columns if c not in ("line_no", "line")], "line_no", F.posexplode_outer(pieces).alias("_k", "line"))
        rows = rows.withColumn("line_no", F.col("line_no").cast("long") * (1 << 24) + F.coalesce("_k", F.lit(0))).drop("_k")
    inside = Window.partitionBy("file_name", "block").orderBy("line_no")
    counted = rows.where("line IS NOT NULL").withColumn("_own", F.sum(F.col("line").rlike(f"^(?:{header})").cast("long")).over(inside))

    def joined(parts: DataFrame, by: tuple[str, ...], order: str, text: str) -> DataFrame:
        in_order = F.array_sort(F.collect_list(F.struct(order, text)))
        return parts.groupBy(*by).agg(F.array_join(F.transform(in_order, lambda x: x[text]), "\n").alias("text"))

    parts = written(joined(counted, ("file_name", "block", "_own"), "line_no", "line"))
    sums = parts.groupBy("file_name", "block").agg(F.max("_own").alias("_sum"))
    before = sums.select("file_name", "block", "_sum", F.coalesce(F.sum("_sum").over(Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row of three numbers for each block.
    placed = parts.join(F.broadcast(before), ["file_name", "block"]).withColumn("ordinal", F.col("_before") + F.col("_own")).where("ordinal > 0")
    edge = (F.col("_own") == 0) | (F.col("_own") == F.col("_sum"))
    whole = placed.where(~edge).select("file_name", "ordinal", "text").unionByName(joined(placed.where(edge), ("file_name", "ordinal"), "block", "text"))
    return whole.select("file_name", "ordinal", F.regexp_extract("text", f"^(?:{header})", 0).alias("header"), clean(F.regexp_replace("text", f"^(?:{header})", "")).alias("body"))


def classify(text: Column, rules: tuple[tuple[str, Callable[[Column], Column]], ...], otherwise: str) -> Column:
    """The first rule that holds."""
    out = None
    for name, holds in rules:
        out = F.when(holds(text), name) if out is None else out.when(holds(text), name)
    return out.otherwise(otherwise)


def canonical(records: DataFrame, fmt: Format, ingested: Column) -> DataFrame:
    """Records as canonical events. Without a level of its own, WARNING records are WARN and all others INFO.

    Columns beside those of every record become attributes.
    """
    level = F.when(F.col("log_level").isNotNull(), normalize_level(F.col("log_level"))).when(F.col("log_type") == "WARNING", "WARN").otherwise("INFO")
    rows = records.withColumn("_time", parse_time(F.col("ts_raw"), ingested))
    # Details are JSON already, so they are put in as they are.
    head = F.to_json(F.struct("correlation_id", *[c for c in records.columns if c not in RECORD]))
    attributes = F.concat(F.left(head, F.length(head) - 1), F.when(head != "{}", ",").otherwise(""), F.lit('"details":'), F.coalesce("details", F.lit("{}")), F.lit("}"))
    return rows.select(
        "file_name",
        F.col("ordinal").cast("int").alias("line_no"),
        F.col("_time.ts").alias("ts_utc"),
        F.coalesce("ts_raw", F.lit("")).alias("ts_raw"),
        F.col("_time.confidence").alias("ts_confidence"),
        level.alias("level"),
        F.lit(fmt.source_system).alias("source_system"),
        F.col("log_type").alias("component"),
        F.coalesce(F.nullif("action", F.lit("")), F.lit("(no action extracted)")).alias("message"),
        "raw",
        attributes.alias("attributes"),
        "correlation_id",
    )


def detect_format(sample: str, score: Callable[[Format], float] | None = None) -> tuple[Format | None, list[str]]:
    """The format of a sample; where several claim it, the one with the best score, and a warning."""
    claims = [f for f in formats() if f.detect(sample)]
    if len(claims) < 2 or score is None:
        return (claims[0] if claims else None), []
    best = max(claims, key=score)
    return best, [f"{', '.join(f.name for f in claims)} all claim this file; {best.name} reads most of it. Name another format to override."]


def score_on(lines: DataFrame) -> Callable[[Format], float]:
    """A score for detect_format(): the share of a sample's records with details."""

    def score(fmt: Format) -> float:
        has = F.col("details").isNotNull() & ~F.col("details").isin("", "{}")
        return float(fmt.records(lines).agg(F.avg(has.cast("int")).alias("x")).first()["x"] or 0.0)

    return score


def formats() -> tuple[Format, ...]:
    from emberlog.operators.formats import older, payments, portals

    return (*portals.FORMATS, *payments.FORMATS, *older.FORMATS)


def by_key(key: str) -> Format:
    return next(f for f in formats() if f.key == key)


def multiline(pattern: str) -> Callable[[str], bool]:
    return lambda text: bool(re.search(pattern, text, re.M))
