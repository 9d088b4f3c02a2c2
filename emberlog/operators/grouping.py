"""Lines to multi-line records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.sources.files import blockwise

#: How a line starts that opens a record whatever the profile says.
STARTS = (
    r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}",
    r"^[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}",
    r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    r"^\d{10}(?:\.\d+)?",
    r'(?s)^\{.*"timestamp".*\}',
)


def opens_record(line: Column, mode: str = "starts_with_timestamp", pattern: str | None = None, also: str | None = None) -> Column:
    """True where a line starts a record: by the profile's mode, by its own pattern `also`, or by its beginning."""
    known = line.rlike("|".join(f"(?:{s})" for s in STARTS))
    if mode == "regex_pattern" and pattern:
        known = known | line.rlike(pattern)
    elif mode == "indent":
        known = known | ~line.rlike(r"^[ \t]")
    return known | line.rlike(also) if also else known


def group_lines(lines: DataFrame, start: Column, chunk: int | None = None) -> DataFrame:
    """file_name, line_no (of the header), header, continuation, raw: records of a header and the lines that follow it.

    Blank lines are left out. Lines before the first start are a record of their own. chunk: records also end after so
    many physical lines. No file is put into one task; a record is gathered whole, as it becomes one row.
    """
    rows = lines.where(F.trim("line", F.lit(" \t\r\n\x0b\f")) != "")
    counted = blockwise(rows, start, "_record")
    keys = ["file_name", "_record"]
    if chunk:
        counted = counted.withColumn("_chunk", F.floor((F.col("line_no") - 1) / chunk))
        keys.append("_chunk")
    grouped = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    text = F.transform("_lines", lambda x: x["line"])
    return grouped.select("file_name", F.col("_lines")[0]["line_no"].alias("line_no"), text[0].alias("header"), F.slice(text, 2, F.greatest(F.size("_lines") - 1, F.lit(0))).alias("continuation"), F.array_join(text, "\n").alias("raw"))
