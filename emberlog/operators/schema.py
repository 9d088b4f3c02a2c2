"""The canonical event, its batch, and the bridge from the driver's events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of seq that are numbered together.
RANGE = 1 << 14
EVENT_SCHEMA = "event_id string, batch_id string, file_name string, line_no int, ts_utc timestamp, ts_raw string, ts_confidence string, level string, source_system string, component string, message string, raw string, attributes string"
BATCH_SCHEMA = "batch_id string, file_name string, file_size_bytes long, total_events long, matched_profile string, match_ratio double, uploaded_at timestamp"
EVENT_COLUMNS = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]


def bridge(events: DataFrame) -> DataFrame:
    """The driver's events in canonical form, with correlation_id and role; attributes are the JSON text of props.

    error events of 100 or more are CRITICAL; a user is a transaction, a click its request and a purchase its response.
    """
    kind = F.col("event_type")
    level = F.when((kind == "error") & (F.col("value") >= 100), "CRITICAL").when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "view", "DEBUG").otherwise("INFO")
    file_name = F.concat(F.lit("f"), F.col("user_id") % 3)
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit("b0").alias("batch_id"),
        file_name.alias("file_name"),
        F.col("event_id").alias("seq"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts_utc"),
        level.alias("level"),
        F.concat(F.lit("svc_"), F.col("user_id") % 5).alias("source_system"),
        kind.alias("component"),
        F.col("props").alias("message"),
        F.col("props").alias("attributes"),
        F.col("user_id").cast("string").alias("correlation_id"),
        F.when(kind == "click", "input").when(kind == "purchase", "response").alias("role"),
        F.col("value"),
    )


def number_lines(events: DataFrame) -> DataFrame:
    """Adds line_no, from 1 within a file. Ranges of seq are numbered apart; what lies before one is a row for each."""
    rows = events.withColumn("_range", F.floor(F.col("seq") / RANGE))
    counts = rows.groupBy("file_name", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file_name", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy("file_name", "_range").orderBy("seq")))
    numbered = inside.join(starts, ["file_name", "_range"])
    return numbered.select(*events.columns, (F.col("_before") + F.col("_k")).cast("int").alias("line_no"))
