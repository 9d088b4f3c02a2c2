"""Summaries of payment formats: entities and events of a window by their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import reports
from emberlog.operators.correlate import truthy
from emberlog.session import written

#: Where an entity lies in an event's details, and what its summary counts.
SHAPES: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = {
    "cardinal": ("flow", {"issuer": ("$.issuer_id",), "status": ("$.authentication.status", "$.integrity_status"), "bank_org": ("$.bank_org",), "merchant": ("$.merchant.name",)}),
    "otp": ("record", {"org": ("$.org",), "queue": ("$.queue",), "currency": ("$.transaction.currency",), "merchant": ("$.merchant.name", "$.merchant")}),
    "debit": ("transaction", {"issuer": ("$.issuer_id",), "status": ("$.status", "$.integrity_status"), "currency": ("$.transaction.currency",), "merchant": ("$.merchant.name",)}),
    "vflex": ("transaction", {"issuer": ("$.issuer_id",), "status": ("$.status", "$.integrity_status"), "operation": ("$.bank_api.operation",), "channel": ("$.otp.channel",), "merchant": ("$.merchant.name",)}),
}


def entities(events: DataFrame, kind: str, latest: bool = False) -> DataFrame:
    """One entity for each correlation id, from its first event that has one: correlation_id and the entity as JSON text."""
    name, _ = SHAPES[kind]
    entity = F.try_variant_get(F.parse_json("attributes"), f"$.details.{name}", "string").alias("entity")
    rows = events.where("correlation_id IS NOT NULL").select("correlation_id", "ts_utc", "line_no", "event_id", entity)
    # Events without one have no place; a filter would read every document once more.
    place = F.when(F.col("entity") != "{}", F.struct("ts_utc", "line_no", "event_id"))
    return rows.groupBy("correlation_id").agg((F.max_by if latest else F.min_by)("entity", place).alias("entity")).where("entity IS NOT NULL")


def by_dimension(found: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """dimension, value, n for all dimensions of a format, in one pass over the entities; `most` values of merchants alone."""
    found = found.withColumn("_doc", F.parse_json("entity"))
    doc = F.col("_doc")

    def value(paths: tuple[str, ...]) -> Column:
        return F.coalesce(*[truthy(F.try_variant_get(doc, p, "string")) for p in paths], F.lit("UNKNOWN"))

    columns = {name: value(paths) for name, paths in SHAPES[kind][1].items()}
    flags = {name: F.coalesce(F.try_variant_get(doc, p, "boolean"), F.lit(False)).cast("string") for name, p in (("otp_processed", "$.otp_processed"), ("bank_success", "$.bank_api.success"), ("force_verify", "$.force_verify_by_mobile"))}
    flags["check"] = (F.coalesce(F.try_variant_get(doc, "$.integrity_status", "string"), F.lit("")) == "CHECK").cast("string")
    counts = reports.breakdown(found, **columns, **flags)
    return reports.top_of_each(counts, most, of=("merchant",)).drop("place") if most else counts


def record_summary(records: DataFrame, merchants: int = 30) -> DataFrame:
    """dimension, value, n over a format's records: type, level, parse status, phase, and of their entities issuer, currency, channel, merchant.

    Events are counted in the first four, entities (the first event of each correlation that has one) in the others.
    """
    doc = F.try_parse_json(F.coalesce("details", F.lit("{}")))
    get = lambda c, path: truthy(F.try_variant_get(F.col(c), path, "string"))
    entity = F.coalesce(*[F.try_variant_get("doc", f"$.{name}", "string") for name in ("transaction", "flow", "record")])
    whole = records.select("file_name", "ordinal", "log_type", "correlation_id", F.coalesce("log_level", F.lit("INFO")).alias("level"), doc.alias("doc"))
    # Documents are parsed once; what both counts need of them is written.
    rows = written(whole.select("file_name", "ordinal", "log_type", "correlation_id", "level", get("doc", "$.parse_status").alias("parse_status"), get("doc", "$.phase").alias("phase"), entity.alias("entity")))
    events = reports.breakdown(rows, event_type=F.col("log_type"), level=F.col("level"), parse_status=F.col("parse_status"), phase=F.col("phase"))
    first = rows.where("correlation_id IS NOT NULL AND entity IS NOT NULL").groupBy("file_name", "correlation_id").agg(F.min_by("entity", "ordinal").alias("entity"))
    first = first.withColumn("doc", F.parse_json("entity"))
    parts = reports.breakdown(first, issuer=get("doc", "$.issuer_id"), currency=get("doc", "$.transaction.currency"), channel=get("doc", "$.otp.channel"), merchant=get("doc", "$.merchant.name"))
    return events.unionByName(reports.top_of_each(parts, merchants, of=("merchant",)).drop("place"))


def oob_statuses(found: DataFrame) -> DataFrame:
    """Statuses over all histories."""
    history = F.from_json(F.try_variant_get(F.parse_json("entity"), "$.oob.status_history", "string"), "array<string>")
    return found.select(F.explode(history).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def _is_failed(level: Column, parse_status: Column) -> Column:
    return (level == "ERROR") | F.coalesce(parse_status == "partial", F.lit(False))


def failed_as_read(events: DataFrame) -> DataFrame:
    """failed() for events as a parser finds them, with log_level and action: what it asks for are columns yet, so no entity is merged and no document written and parsed."""
    return events.where(_is_failed(F.col("log_level"), F.col("parse_status"))).withColumns({"message": F.col("action"), "warnings": F.col("event_warnings")})


def failed(events: DataFrame, kind: str) -> DataFrame:
    """Events that count as failures, with their first warning: ERROR level or a partial parse; for otp a parse error."""
    doc = F.parse_json("attributes")
    get = lambda path, t="string": F.try_variant_get(doc, path, t)
    bad = get("$.details.parse_error").isNotNull() if kind == "otp" else _is_failed(F.col("level"), get("$.details.parse_status"))
    warnings = F.from_json(get("$.details.warnings"), "array<string>")
    return events.where(bad).withColumn("warnings", F.array(get("$.details.parse_error")) if kind == "otp" else warnings)


def summary(events: DataFrame, kind: str, detail: int = 100) -> dict:
    """A report as a dict. What reaches the driver: counts of top values, ten reasons and `detail` failures."""
    head = reports.envelope(events)
    if head["status"] == "no_data":
        return head
    found = entities(events, kind)
    counts: dict[str, dict[str, int]] = {}
    for r in by_dimension(found, kind, 15).orderBy(F.desc("n"), "value").collect():
        counts.setdefault(r["dimension"], {})[r["value"]] = r["n"]
    types = {r["value"]: r["n"] for r in events.groupBy(F.coalesce("component", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").collect()}
    bad = failed(events, kind)
    items = bad.orderBy("ts_utc", "line_no", "event_id").limit(detail).select("ts_utc", "correlation_id", "message").collect()
    out = {**head, "entities": found.count(), "event_types": types, "by": counts, "failed": {"count": bad.count(), "reasons": {r["reason"]: r["n"] for r in reports.failure_reasons(bad).collect()}, "items": [r.asDict() for r in items]}}
    if kind == "cardinal":
        out["oob"] = {r["status"]: r["n"] for r in oob_statuses(found).collect()}
    if kind == "otp":
        n, done = out["entities"], counts.get("otp_processed", {}).get("true", 0)
        out["success_rate"] = round(100 * done / n, 1) if n else None
    return out
