"""Filters, pages, look-ups and distributions over canonical events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import rank
from emberlog.functions.times import hour_label

ALL = "ALL"


def like_pattern(term: str, literal: bool = False) -> str:
    """A search term for LIKE: its % and _ are wildcards unless literal; backslashes never escape."""
    term = term.replace("\\", "\\\\")
    if literal:
        term = term.replace("%", "\\%").replace("_", "\\_")
    return f"%{term}%"


def matching(events: DataFrame, level: str | None = None, source_system: str | None = None, component: str | None = None, batch_id: str | None = None, search: str | None = None, since=None, until=None, literal: bool = False) -> DataFrame:
    """Events that pass all given filters. Empty values and "ALL" don't filter; times are inclusive.

    Equalities and times are plain comparisons, so Parquet statistics and partitions prune.
    """
    for name, value in (("level", level), ("source_system", source_system), ("component", component)):
        if value and value != ALL:
            events = events.where(F.col(name) == value)
    if batch_id:
        events = events.where(F.col("batch_id") == batch_id)
    if search:
        pattern = like_pattern(search, literal)
        events = events.where(F.col("message").ilike(pattern) | (F.col("raw") if "raw" in events.columns else F.col("message")).ilike(pattern) | F.coalesce(F.col("component").ilike(pattern), F.lit(False)))
    if since is not None:
        events = events.where(F.col("ts_utc") >= F.lit(since).cast("timestamp"))
    if until is not None:
        events = events.where(F.col("ts_utc") <= F.lit(until).cast("timestamp"))
    return events


def page(events: DataFrame, number: int = 1, size: int = 200) -> DataFrame:
    """One page, newest first, then by line and id."""
    if not 1 <= size <= 5000 or number < 1:
        raise ValueError("a page has 1 to 5000 rows and a number from 1")
    return events.orderBy(F.col("ts_utc").desc_nulls_last(), F.col("line_no").asc_nulls_last(), "event_id").offset((number - 1) * size).limit(size)


def page_after(events: DataFrame, after: tuple[dt.datetime | None, int | None, str] | None = None, size: int = 200) -> DataFrame:
    """The page that follows a row (its ts_utc, line_no, event_id) in the order of page(), or the first one.

    A filter and a top-k: no row before is sorted or skipped, so a late page costs no more than the first.
    """
    if not 1 <= size <= 5000:
        raise ValueError("a page has 1 to 5000 rows")
    if after:
        at, line, event = F.lit(after[0]).cast("timestamp"), F.lit(after[1]).cast("int"), F.lit(after[2])
        ts, no = F.col("ts_utc"), F.col("line_no")
        later = (ts < at) | (ts.isNull() & at.isNotNull())
        lower = (no > line) | (no.isNull() & line.isNotNull())
        events = events.where(later | (ts.eqNullSafe(at) & (lower | (no.eqNullSafe(line) & (F.col("event_id") > event)))))
    return events.orderBy(F.col("ts_utc").desc_nulls_last(), F.col("line_no").asc_nulls_last(), "event_id").limit(size)


def cursor(page: list) -> tuple | None:
    """Where the page after these rows begins; None after an empty one."""
    return (page[-1]["ts_utc"], page[-1]["line_no"], page[-1]["event_id"]) if page else None


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id).limit(1)


def surroundings(events: DataFrame, targets: DataFrame, lines: int = 5) -> DataFrame:
    """Events of the same file within so many lines of each target: target_id, is_target and the event's columns.

    A band join on ranges of lines: both sides meet by file and block of lines, so a large file isn't one key.
    """
    if not 1 <= lines <= 50:
        raise ValueError("context is 1 to 50 lines")
    span = 2 * lines + 1
    t = targets.select(F.col("event_id").alias("target_id"), F.col("file_name").alias("_file"), F.col("line_no").alias("_line"))
    t = t.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor((F.col("_line") - lines) / span), F.floor((F.col("_line") + lines) / span)))))
    e = events.withColumn("_own", F.floor(F.col("line_no") / span))
    near = e.join(t, (e["file_name"] == t["_file"]) & (e["_own"] == t["_block"]) & F.col("line_no").between(F.col("_line") - lines, F.col("_line") + lines))
    return near.withColumn("is_target", F.col("event_id") == F.col("target_id")).drop("_file", "_line", "_block", "_own")


def count_by(events: DataFrame, column: str, name: str = "n") -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias(name))


def component_errors(events: DataFrame) -> DataFrame:
    """ERROR and CRITICAL events by component; null is "unknown"."""
    return events.where(F.col("level").isin("ERROR", "CRITICAL")).groupBy(F.coalesce("component", F.lit("unknown")).alias("component")).agg(F.count("*").alias("n"))


def hourly_levels(events: DataFrame) -> DataFrame:
    return events.where("ts_utc IS NOT NULL").groupBy(hour_label(F.col("ts_utc")).alias("hour"), "level").agg(F.count("*").alias("n"))


def hourly_totals(events: DataFrame) -> DataFrame:
    return hourly_levels(events).groupBy("hour").agg(F.sum("n").alias("n"))


def error_ratio(events: DataFrame) -> DataFrame:
    """total, errors and their share to four places, 0 where there is nothing."""
    bad = F.count_if(F.col("level").isin("ERROR", "CRITICAL"))
    return events.agg(F.count("*").alias("total"), bad.alias("errors"), F.coalesce(F.round(bad / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("error_ratio"))


def outliers(counts: DataFrame, value: str = "n", least: float = 2.0, groups: int = 3) -> DataFrame:
    """Rows whose value lies `least` sample deviations or more above the mean, with z to two places, the furthest first.

    The statistics are one row, so the join with them is a broadcast of one row.
    """
    stats = counts.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count("*").alias("_g"))
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    return counts.join(F.broadcast(stats)).where((F.col("_g") >= groups) & (F.col("_s") > 0)).where(z >= least).select(*counts.columns, F.round(z, 2).alias("z")).orderBy(F.desc("z"), *counts.columns)


def anomaly_report(events: DataFrame) -> DataFrame:
    """Outlying hours and components, by kind and name."""
    hours = outliers(hourly_totals(events)).select(F.lit("hour").alias("kind"), F.col("hour").alias("name"), "n", "z")
    parts = outliers(component_errors(events)).select(F.lit("component").alias("kind"), F.col("component").alias("name"), "n", "z")
    return hours.unionByName(parts)


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    """Distinct values of level, source_system or component; other columns have none to offer."""
    if column not in ("level", "source_system", "component"):
        return events.select(F.lit(None).cast("string").alias("value")).limit(0)
    return events.select(F.col(column).alias("value")).distinct().na.drop()


def severity_share(events: DataFrame) -> DataFrame:
    """Levels that occur with their count and percentage to one place."""
    n = count_by(events, "level")
    total = F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return n.select("level", "n", F.round(100 * F.col("n") / total, 1).alias("pct"))


def timeline(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Events for each span of minutes, over all events."""
    return events.where("ts_utc IS NOT NULL").groupBy(F.window("ts_utc", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "n", "errors")


def minute_features(events: DataFrame) -> DataFrame:
    """Counts by minute with empty minutes filled in, and the hour on a circle."""
    m = events.groupBy(F.date_trunc("minute", "ts_utc").alias("minute")).agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"), F.count_distinct("correlation_id").alias("correlations"))
    ends = m.agg(F.min("minute").alias("a"), F.max("minute").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.expr("sequence(a, b, interval 1 minute)")).alias("minute"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "errors", "warnings", "correlations")]
    angle = F.hour("minute") * (2 * 3.141592653589793 / 24)
    filled = every.join(m, "minute", "left").select("minute", *zero)
    return filled.withColumn("error_ratio", F.round(F.coalesce(F.col("errors") / F.nullif("n", F.lit(0)), F.lit(0.0)), 4)).withColumn("hour_sin", F.round(F.sin(angle), 6) + 0.0).withColumn("hour_cos", F.round(F.cos(angle), 6) + 0.0)


def top(events: DataFrame, by: Column, k: int, name: str = "value") -> DataFrame:
    """The k most frequent values; ties by value."""
    return events.groupBy(by.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(name)).limit(k)


def resolve_range(now: dt.datetime, hours: int = 24, since: dt.datetime | None = None, until: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime]:
    """A given start wins and ends now unless said otherwise; else the last hours, 1 to 720 of them."""
    if since:
        return since, until or now
    if not 1 <= hours <= 720:
        raise ValueError("a look-back is 1 to 720 hours")
    return now - dt.timedelta(hours=hours), now


def for_analysis(events: DataFrame, since: dt.datetime, until: dt.datetime, most: int | None = None, **filters) -> DataFrame:
    """Events of a window, oldest first, by line and id where times are equal. All of them, or the oldest `most`."""
    found = matching(events, since=since, until=until, **filters).orderBy("ts_utc", "line_no", "event_id")
    return found.limit(most) if most else found


def in_time(events: DataFrame) -> DataFrame:
    """Events with a time, in its order."""
    return events.where("ts_utc IS NOT NULL").orderBy("ts_utc", "event_id")


def flat(rows: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """The other columns, and a text column for each path into a column of JSON text."""
    doc = rows.withColumn("_doc", F.try_parse_json(column))
    return doc.select(*[F.col(f"`{c}`") for c in rows.columns if c != column], *[F.try_variant_get("_doc", p, "string").alias(n) for n, p in paths.items()])


def by_severity(events: DataFrame) -> Column:
    return F.coalesce(rank(F.col("level")), F.lit(-1))
