"""Investigation reports: small aggregates over correlated events, and findings put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators import correlate
from emberlog.operators.correlate import truthy
from emberlog.session import Config


def availability_counters(pairs: DataFrame) -> DataFrame:
    """Counts over all inputs; late ones in per cent of those that were answered."""
    n, answered = F.count("*"), F.count_if(F.col("status") == "responded")
    lost, late = F.count_if(F.col("status") == "unresponded"), F.count_if("is_delayed")
    return pairs.agg(n.alias("inputs"), answered.alias("responded"), lost.alias("unresponded"), late.alias("delayed"), F.coalesce(F.round(100 * lost / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("unresponded_pct"), F.coalesce(F.round(100 * late / F.nullif(answered, F.lit(0)), 1), F.lit(0.0)).alias("delayed_pct"))


def failure_reasons(failed: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent reasons: the first warning, else the message, cut to 120 characters."""
    reason = F.coalesce(truthy(F.col("message")), F.lit("Error event"))
    if "warnings" in failed.columns:
        reason = F.coalesce(truthy(F.get("warnings", F.lit(0))), reason)
    return failed.groupBy(F.substring(reason, 1, 120).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def breakdown(entities: DataFrame, **dimensions: Column) -> DataFrame:
    """Counts of each value of each dimension: dimension, value, n. One scan explodes all dimensions, then counts."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value")) for name, value in dimensions.items()])
    return entities.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def top_of_each(counts: DataFrame, k: int = 15, of: tuple[str, ...] | None = None) -> DataFrame:
    """The k most frequent values of each dimension, or of the named ones with all values of the others; ties by value."""
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where((F.col("place") <= k) | (~F.col("dimension").isin(*of) if of else F.lit(False)))


def envelope(events: DataFrame) -> dict:
    """Status, first and last time and number of what a report is about."""
    row = events.agg(F.count("*").alias("n"), F.min("ts_utc").alias("a"), F.max("ts_utc").alias("b")).first()
    if not row["n"]:
        return {"status": "no_data", "message": "No events in the analyzed window."}
    return {"status": "ok", "window_start": row["a"], "window_end": row["b"], "total_events": row["n"]}


def availability(events: DataFrame, components=("vplus_input", "vplus_response", "netcetera_response"), gap_minutes: int = 10, expected_ms: int = 1000, grace_ms: int = 5000, now=None, detail: int = 50) -> dict:
    """Whether the service answers: status (no_data, healthy, down), counters, windows of downtime and lost requests.

    Pairs are few columns of input rows; what reaches the driver is one row of counters, the windows and `detail` rows.
    """
    name = F.col("component")
    active = events.where(name.isin(*components) & F.col("ts_utc").isNotNull())
    if active.isEmpty():
        return {"status": "no_data", "downtime_windows": [], "currently_down": None}
    pairs = correlate.response_pairs(active, name == components[0], name == components[1], expected_ms, grace_ms, F.lit(now) if now is not None else None)
    counters = availability_counters(pairs).first().asDict()
    windows = [r.asDict() for r in correlate.downtime_islands(pairs, gap_minutes).orderBy("down_since", "first_event").collect()]
    lost = pairs.where("status = 'unresponded'").orderBy("ts_utc", "event_id").limit(detail).select("correlation_id", "event_id", "ts_utc").collect()
    last = pairs.orderBy(F.desc("ts_utc"), F.desc("event_id")).select("status").first()
    down = bool(windows) and windows[-1]["recovered_at"] is None and last is not None
    return {"status": "down" if down else "healthy", **counters, "downtime_windows": windows, "total_downtime_minutes": round(sum(w["duration_minutes"] or 0 for w in windows), 1), "currently_down": down, "worst_unresponded": [r.asDict() for r in lost]}


def response_times(events: DataFrame, expected_ms: int = 1000, detail: int = 50) -> dict:
    name = F.col("component")
    heads = correlate.head_pairs(events, name == "vplus_input", name == "vplus_response")
    stats = correlate.response_stats(heads, expected_ms).first().asDict()
    if not stats["pairs"]:
        return {"status": "no_data", "expected_response_ms": expected_ms}
    worst = heads.where(F.col("response_ms") > expected_ms).orderBy(F.desc("response_ms"), "correlation_id").limit(detail)
    return {"status": "ok", "expected_response_ms": expected_ms, **stats, "worst_delays": [r.asDict() for r in worst.collect()]}


def sms_flows(events: DataFrame, expected_ms: int = 30000, detail: int = 50) -> dict:
    name = F.col("component")
    flows = correlate.delivery_flows(events, name == "sms_input", name == "sms_queue", name == "otp_success", expected_ms)
    ms = F.col("queue_ms")
    row = flows.agg(F.count("*").alias("n"), F.count(ms).alias("timed"), F.round(F.sum(ms), 1).alias("total_ms"), F.round(F.avg(ms), 1).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(100 * F.count_if("is_queue_delayed") / F.nullif(F.count("*"), F.lit(0)), 1).alias("delayed_pct")).first().asDict()
    n, timed = row.pop("n"), row.pop("timed")
    if not n:
        return {"status": "no_data"}
    counts = {r["outcome"]: r["n"] for r in flows.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    open_flows = flows.where("outcome <> 'otp_confirmed'").orderBy("requested_time", "correlation_id").limit(detail)
    return {"status": "ok", "total": n, "outcome_counts": counts, "queue_delay_stats": row if timed else None, "unresolved": [r.asDict() for r in open_flows.collect()]}


def transactions(events: DataFrame) -> DataFrame:
    """One vote for each transaction: its first event that carries an entity, with issuer and status."""
    doc = F.parse_json("attributes")
    entity = F.try_variant_get(doc, "$.details.transaction", "string")
    rows = events.where("correlation_id IS NOT NULL").withColumn("_tx", entity).where("_tx IS NOT NULL AND _tx <> '{}'")
    first = correlate.first_of_each(rows)
    get = lambda path, kind="string": F.try_variant_get(F.parse_json("_tx"), path, kind)
    status = F.coalesce(truthy(get("$.stepup_status")), F.when(get("$.otp_processed", "boolean"), "OTP_PROCESSED"), F.lit("UNKNOWN"))
    return first.select("correlation_id", F.coalesce(truthy(get("$.issuer_id")), F.lit("UNKNOWN")).alias("issuer"), status.alias("status"))


def investigation(events: DataFrame, vplus: dict, times: dict, sms: dict, most: int = 20) -> dict:
    """Findings by severity: outages, late answers, unconfirmed messages, merchants and messages that errors share."""
    errors = events.where("level = 'ERROR'")
    doc = F.parse_json("attributes")
    merchant = truthy(F.try_variant_get(doc, "$.details.transaction.merchant.name", "string"))
    issuer = truthy(F.try_variant_get(doc, "$.details.transaction.issuer_id", "string"))
    counts = top_of_each(breakdown(errors, message=F.substring(F.coalesce("message", F.lit("")), 1, 120), merchant=merchant, issuer=issuer), 10).orderBy("dimension", "place").collect()
    ranked = {d: [(r["value"], r["n"]) for r in counts if r["dimension"] == d] for d in ("message", "merchant", "issuer")}
    found: list[tuple[int, str, str]] = []
    for w in vplus.get("downtime_windows", [])[:5]:
        if w["recovered_at"]:
            found.append((1, "high", f"Outage: {w['unresponded_count']} requests without an answer from {w['down_since']} to {w['recovered_at']} ({w['duration_minutes']} min)"))
        else:
            found.append((0, "critical", f"Down: {w['unresponded_count']} requests without an answer since {w['down_since']}"))
    if times.get("status") == "ok" and (times["delayed_pct"] or 0) >= 10:
        found.append((2, "medium", f"{times['delayed_pct']}% of answers took more than {times['expected_response_ms']} ms"))
    if sms.get("status") == "ok" and (lost := 100 - 100 * sms["outcome_counts"].get("otp_confirmed", 0) / sms["total"]) >= 20:
        found.append((2, "medium", f"{round(lost, 1)}% of messages were never confirmed"))
    found += [(2, "medium", f"Merchant {m} has {n} error events") for m, n in ranked["merchant"][:5]]
    found += [(3, "low", f"Error seen {n} times: {m}") for m, n in ranked["message"][:5] if n > 1]
    total = events.agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("e")).first()
    return {"total_events": total["n"], "total_errors": total["e"], "findings": [{"severity": s, "finding": t} for _, s, t in sorted(found, key=lambda x: x[0])[:most]], **{f"{d}s": dict(v) for d, v in ranked.items()}}


def health(events: DataFrame, config: Config = Config(), now=None) -> dict:
    """availability, response_times, sms and investigation, by an installation's thresholds."""
    vplus = config.of(availability, now=now)(events)
    times = config.of(response_times)(events)
    # Messages are late by the time that they wait in the queue.
    sms = config.of(sms_flows, expected_ms=config.queue_ms)(events)
    return {"availability": vplus, "response_times": times, "sms": sms, "investigation": investigation(events, vplus, times, sms)}
