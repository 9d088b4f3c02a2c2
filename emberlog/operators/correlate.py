"""Correlation across events: as-of pairs, islands, group heads, merges, carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.graphs import components

from emberlog.functions.times import elapsed_ms


def response_pairs(events: DataFrame, is_input: Column, is_response: Column, expected_ms: int = 1000, grace_ms: int = 5000, now: Column | None = None) -> DataFrame:
    """Every input with the first response at or after it in its transaction; a response may serve many inputs.

    status: responded; unresponded once grace_ms have passed by now; pending before that, or if the input lies in the
    future. A range frame finds the response in one pass, and peers at the same instant pair.
    """
    now = now if now is not None else F.current_timestamp()
    rows = events.where((is_input | is_response) & F.col("ts_utc").isNotNull() & F.col("correlation_id").isNotNull() & (F.col("correlation_id") != ""))
    # "From here to the end of the transaction", sorted backwards, is a running minimum.
    back = Window.partitionBy("correlation_id").orderBy(F.col("ts_utc").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    paired = rows.withColumn("response_time", F.min(F.when(is_response, F.col("ts_utc"))).over(back)).where(is_input)
    took = elapsed_ms(F.col("ts_utc"), F.col("response_time"))
    age = elapsed_ms(F.col("ts_utc"), now)
    status = F.when(F.col("response_time").isNotNull(), "responded").when(age >= grace_ms, "unresponded").otherwise("pending")
    return paired.withColumn("status", status).withColumn("response_ms", took).withColumn("is_delayed", F.coalesce(took > expected_ms, F.lit(False)))


def downtime_islands(pairs: DataFrame, gap_minutes: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of consecutive unresponded inputs: down_since, recovered_at, duration_minutes, unresponded_count, first_event.

    A run ends at an input of another status, whose time is the recovery, or where the next one is more than
    gap_minutes later. Without `by` all inputs are one sequence, as for a single service; pass its column for several.
    No sequence is one task: hours are, and one row for each hour ties them together.
    """
    bad, at = F.col("status") == "unresponded", F.struct("ts_utc", "event_id")
    rows = pairs.withColumn("_block", F.date_trunc("hour", "ts_utc"))
    inside = Window.partitionBy(*by, "_block").orderBy("ts_utc", "event_id")
    across = Window.partitionBy(*by).orderBy("_block")
    # Hours are looked at apart; what an hour must know of those beside it is its neighbours' first and last input.
    own = F.struct("status", "ts_utc")
    ends = rows.groupBy(*by, "_block").agg(F.min_by(own, at).alias("_first"), F.max_by(own, at).alias("_last"))
    edges = ends.select(*by, "_block", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    rows = rows.join(edges, [*by, "_block"])
    before, after = F.coalesce(F.lag(own).over(inside), F.col("_before")), F.coalesce(F.lead(own).over(inside), F.col("_after"))
    rows = rows.withColumn("_p", before).withColumn("_n", after)
    gap = F.unix_timestamp("ts_utc") - F.unix_timestamp("_p.ts_utc") > gap_minutes * 60
    starts = bad & F.coalesce((F.col("_p.status") != "unresponded") | gap, F.lit(True))
    rows = rows.where(bad).withColumn("_start", F.when(starts, at)).withColumn("_next_status", F.col("_n.status")).withColumn("_next_time", F.col("_n.ts_utc"))
    last = rows.groupBy(*by, "_block").agg(F.max("_start").alias("_own"))
    carry = last.select(*by, "_block", F.last_value("_own", ignoreNulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    latest = F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(carry, [*by, "_block"]).withColumn("_run", F.coalesce(latest, F.col("_open")))
    runs = rows.where(bad).groupBy(*by, "_run").agg(
        F.min("ts_utc").alias("down_since"),
        F.max_by(F.when(F.col("_next_status") != "unresponded", F.col("_next_time")), F.struct("ts_utc", "event_id")).alias("recovered_at"),
        F.count("*").alias("unresponded_count"),
        F.min_by("event_id", F.struct("ts_utc", "event_id")).alias("first_event"),
    )
    minutes = (F.unix_timestamp("recovered_at") - F.unix_timestamp("down_since")) / 60
    return runs.select(*by, "down_since", "recovered_at", F.round(minutes, 1).alias("duration_minutes"), "unresponded_count", "first_event")


def head_pairs(events: DataFrame, is_input: Column, is_response: Column) -> DataFrame:
    """For each transaction its first input and the first response at or after it, where there is one."""
    first = Window.partitionBy("correlation_id")
    rows = events.where((is_input | is_response) & F.col("ts_utc").isNotNull() & F.col("correlation_id").isNotNull())
    rows = rows.withColumn("input_time", F.min(F.when(is_input, F.col("ts_utc"))).over(first))
    heads = rows.where("input_time IS NOT NULL").groupBy("correlation_id", "input_time").agg(F.min(F.when(is_response & (F.col("ts_utc") >= F.col("input_time")), F.col("ts_utc"))).alias("response_time"))
    return heads.where("response_time IS NOT NULL").withColumn("response_ms", F.round(elapsed_ms(F.col("input_time"), F.col("response_time")), 1))


def response_stats(heads: DataFrame, expected_ms: int = 1000) -> DataFrame:
    ms, n = F.col("response_ms"), F.count("*")
    late = F.count_if(ms > expected_ms)
    return heads.agg(n.alias("pairs"), F.round(F.sum(ms), 1).alias("total_ms"), F.round(F.avg(ms), 1).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), late.alias("delayed"), F.round(100 * late / F.nullif(n, F.lit(0)), 1).alias("delayed_pct"))


def delivery_flows(events: DataFrame, requested: Column, queued: Column, confirmed: Column, expected_ms: int = 30000) -> DataFrame:
    """For each transaction with a request: first times, delays (null where negative) and the outcome. No order is demanded."""
    heads = events.where("correlation_id IS NOT NULL").groupBy("correlation_id").agg(
        F.min(F.when(requested, F.col("ts_utc"))).alias("requested_time"),
        F.min(F.when(queued, F.col("ts_utc"))).alias("queued_time"),
        F.min(F.when(confirmed, F.col("ts_utc"))).alias("confirmed_time"),
    )
    delay = elapsed_ms(F.col("requested_time"), F.col("queued_time"))
    return heads.where("requested_time IS NOT NULL").select(
        "*",
        delay.alias("queue_ms"),
        F.coalesce(delay > expected_ms, F.lit(False)).alias("is_queue_delayed"),
        elapsed_ms(F.col("queued_time"), F.col("confirmed_time")).alias("completion_ms"),
        F.when(F.col("confirmed_time").isNotNull(), "otp_confirmed").when(F.col("queued_time").isNotNull(), "queued_no_confirmation").otherwise("queue_failed").alias("outcome"),
    )


def truthy(value: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(value, F.lit(""))


def first_nonempty(value: Column, order: Column) -> Column:
    """Aggregate: the value that comes first among those that are neither null nor empty."""
    return F.min_by(truthy(value), F.when(truthy(value).isNotNull(), order))


def last_nonempty(value: Column, order: Column) -> Column:
    return F.max_by(truthy(value), F.when(truthy(value).isNotNull(), order))


def ordered_distinct(value: Column, order: Column) -> Column:
    """Aggregate: distinct non-empty values in order of their first place."""
    pairs = F.array_sort(F.collect_list(F.when(truthy(value).isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


#: Rows of a file whose values are carried together.
CARRY_ROWS = 1 << 14


def carried(rows: DataFrame, name: str, value: Column, order: str, within: tuple[str, ...] = ("batch_id",), before: bool = False) -> DataFrame:
    """Adds a column: the last non-null value up to this row, or strictly before it, by a whole-numbered order.

    Ranges of the order are looked at apart; what a range takes over from those before is one row for each range.
    """
    whole = rows.withColumn("_value", value).withColumn("_range", F.floor(F.col(order) / CARRY_ROWS))
    frame = Window.partitionBy(*within, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    inside = whole.withColumn("_own", F.last_value("_value", ignoreNulls=True).over(frame))
    ends = whole.groupBy(*within, "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select(*within, "_range", F.last_value("_last", ignoreNulls=True).over(earlier).alias("_taken"))
    return inside.join(taken, [*within, "_range"]).withColumn(name, F.coalesce("_own", "_taken")).drop("_value", "_range", "_own", "_taken")


def first_of_each(events: DataFrame, key: str = "correlation_id", latest: bool = False) -> DataFrame:
    """One event for each key: the earliest by time, line and id, or the latest."""
    order, whole = F.struct("ts_utc", "line_no", "event_id"), F.struct(*[F.col(f"`{c}`") for c in events.columns])
    chosen = (F.max_by if latest else F.min_by)(whole, order)
    # An aggregate with a map-side part: a key with many events costs a row for each task.
    return events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(chosen.alias("_row")).select("_row.*")


def resolve_aliases(records: DataFrame, within: str = "batch_id") -> DataFrame:
    """Flow of each record with aliases (array, in order of trust): within, ordinal, flow.

    Record by record: the first alias that is known names the flow, else the first alias does; all its aliases then
    point there, and flows never merge. That is sequential, but no alias of one connected component of aliases ever
    decides about another's. So each component within a batch is walked by itself, in the order of its records; a task streams over its
    components and holds the aliases of one. Records without aliases have no flow and are dealt by their place.
    """

    def walk(batches):
        import pyarrow as pa

        now, known = object(), {}
        for b in batches:
            flows = []
            for part, aliases in zip(zip(b.column(0).to_pylist(), b.column(3).to_pylist()), b.column(2).to_pylist()):
                if part != now:
                    now, known = part, {}
                flow = next((known[a] for a in aliases if a in known), aliases[0] if aliases else None)
                for a in aliases:
                    known[a] = flow
                flows.append(flow)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(flows, "string")], [within, "ordinal", "flow"])

    named = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    rows = records.select(within, F.col("ordinal").cast("long").alias("ordinal"), named.alias("aliases"))

    def node(alias: Column) -> Column:
        return F.when(alias.isNotNull(), F.struct(F.col(within).alias("w"), alias.alias("a")))

    first = node(F.get("aliases", F.lit(0)))
    pairs = rows.where(F.size("aliases") > 1).select(first.alias("a"), F.explode(F.transform(F.slice("aliases", 2, F.size("aliases")), node)).alias("b"))
    found = components(pairs).select(F.col("node").alias("_node"), F.col("component.a").alias("_part"))
    met = rows.withColumn("_node", first).join(found, "_node", "left")
    alone = F.coalesce(F.get("aliases", F.lit(0)), F.concat(F.lit("\0"), F.col("ordinal").cast("string")))
    parts = met.select(within, "ordinal", "aliases", F.coalesce("_part", alone).alias("part"))
    return parts.repartition(within, "part").sortWithinPartitions(within, "part", "ordinal").mapInArrow(walk, f"{within} string, ordinal long, flow string")
