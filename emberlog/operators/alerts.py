"""Alert rules over events: matches, digests, and suppression of repeats."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import RANKS, reaches

#: So many rules are a configuration; beyond that they are data and would need a join of another kind.
MOST_RULES = 10_000
RULE_SCHEMA = "rule string, min_level string, mode string, source_system_filter string, component_filter string, message_contains string, dedup_window_minutes int"


@dataclass(frozen=True)
class Rule:
    """A filter that is empty lets everything pass; text filters are "contains", in any case."""

    rule: str
    min_level: str = "ERROR"
    mode: str = "immediate"
    source_system_filter: str | None = None
    component_filter: str | None = None
    message_contains: str | None = None
    dedup_window_minutes: int = 15

    def __post_init__(self):
        if not self.rule.strip():
            raise ValueError("a rule has a name")
        if self.min_level not in (*RANKS, "UNKNOWN"):
            raise ValueError(f"no such level: {self.min_level}")
        if self.mode not in ("immediate", "digest"):
            raise ValueError(f"no such mode: {self.mode}")
        if self.dedup_window_minutes < 0:
            raise ValueError("a window has 0 minutes or more")


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """A row for each rule; names are unique in any case. Rules are configuration, so they are few."""
    rules = list(rules)
    if len({r.rule.lower() for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rules], RULE_SCHEMA)


def matches(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events by the rules that they match. Rules are configuration: MOST_RULES at most, so they are broadcast."""
    if len(rules.take(MOST_RULES + 1)) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")

    def has(value: str, part: str) -> Column:
        wanted = F.coalesce(F.lower(part), F.lit(""))
        return (wanted == "") | F.contains(F.lower(F.coalesce(F.col(value), F.lit(""))), wanted)

    condition = reaches(F.col("level"), F.col("min_level")) & has("source_system", "source_system_filter") & has("component", "component_filter") & has("message", "message_contains")
    return events.join(F.broadcast(rules), condition)


def dedup_key(rule: Column, *parts: Column) -> Column:
    """What makes two alerts of a rule the same."""
    return F.sha2(F.concat_ws("|", rule, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def immediate(matched: DataFrame) -> DataFrame:
    """Matches of immediate rules with their key: rule, source, component and the message's first 100 characters."""
    return matched.where("mode = 'immediate'").withColumn("dedup_key", dedup_key(F.col("rule"), F.col("source_system"), F.col("component"), F.substring("message", 1, 100)))


def digests(matched: DataFrame, samples: int = 5) -> DataFrame:
    """One row for each digest rule and batch: count, the newest sample lines, the newest event's source, and a key with the count.

    Counts are aggregated with a map-side part; the newest few come from a rank with a bound, which Spark applies
    before the shuffle as well. So no group is gathered whole.
    """
    order = F.struct((-F.unix_micros("ts_utc")).alias("age"), "line_no", "event_id")
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("level"), F.lit("]")), F.col("component"), F.substring("message", 1, 120))
    found = matched.where("mode = 'digest'").select("rule", "batch_id", "source_system", line.alias("line"), order.alias("order"))
    counts = found.groupBy("rule", "batch_id").agg(F.count("*").alias("n"))
    ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy("rule", "batch_id").orderBy("order"))).where(F.col("_k") <= samples)
    newest = ranked.groupBy("rule", "batch_id").agg(F.min_by("source_system", "_k").alias("source_system"), F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda x: x["line"]).alias("lines"))
    out = counts.join(newest, ["rule", "batch_id"])
    return out.withColumn("dedup_key", dedup_key(F.col("rule"), F.lit("digest"), F.col("n").cast("string")))


def suppress(alerts: DataFrame, at: str = "ts_utc") -> DataFrame:
    """Alerts that fire: each the first of its key, or at least the rule's window after the last that fired.

    Suppressed ones don't prolong the window, which makes it a fold over each key in time. Rows stream through a task in
    the order of key and time; it remembers one time. A window of 0 suppresses nothing.
    """

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        key, last = object(), None
        for b in batches:
            keys, when = b.column("dedup_key").to_pylist(), b.column("_micros").to_pylist()
            windows = b.column("dedup_window_minutes").to_pylist()
            fires = np.zeros(len(keys), bool)
            for i, (k, t, w) in enumerate(zip(keys, when, windows)):
                if k != key:
                    key, last = k, None
                if last is None or t - last >= w * 60_000_000:
                    fires[i], last = True, t
            yield b.filter(pa.array(fires))

    rows = alerts.withColumn("_micros", F.unix_micros(at))
    ordered = rows.repartition("dedup_key").sortWithinPartitions("dedup_key", "_micros", "event_id") if "event_id" in alerts.columns else rows.repartition("dedup_key").sortWithinPartitions("dedup_key", "_micros")
    return ordered.mapInArrow(fold, ordered.schema).drop("_micros")


#: The rules that a new store starts with.
SEEDS = (Rule("CRITICAL immediate", "CRITICAL", "immediate", dedup_window_minutes=15), Rule("ERROR digest", "ERROR", "digest", dedup_window_minutes=60))


class RuleStore:
    """Rules as a small table of versions: each change writes all rules anew under the next number, and the last one counts.

    A store is seeded when it has no version yet, so seeds that were deleted don't come back.
    """

    SCHEMA = f"rule_id string, {RULE_SCHEMA}, enabled boolean, created int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if self._version() is None:
            self._write(0, [self._row(r, i) for i, r in enumerate(SEEDS)])

    def _version(self) -> int | None:
        try:
            return self.spark.read.parquet(self.path).agg(F.max("version").alias("v")).first()["v"]
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _write(self, version: int, rows: list[dict]) -> None:
        # A row of its own stands for the version where no rule is left.
        made = [*rows, dict.fromkeys(self.SCHEMA.replace(",", "").split()[::2])]
        self.spark.createDataFrame(made, self.SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    @staticmethod
    def _row(rule: Rule, created: int, enabled: bool = True, rule_id: str | None = None) -> dict:
        return {"rule_id": rule_id or uuid.uuid4().hex, **asdict(rule), "enabled": enabled, "created": created}

    def frame(self, enabled_only: bool = False) -> DataFrame:
        """The rules, oldest first."""
        rows = self.spark.read.schema(f"{self.SCHEMA}, version int").parquet(self.path).where(F.col("version") == self._version()).where("rule_id IS NOT NULL").drop("version")
        return (rows.where("enabled") if enabled_only else rows).orderBy("created", "rule_id")

    def _rows(self) -> list[dict]:
        return [r.asDict() for r in self.frame().collect()]

    def get(self, rule_id: str) -> dict:
        found = [r for r in self._rows() if r["rule_id"] == rule_id]
        if not found:
            raise KeyError(rule_id)
        return found[0]

    def _save(self, rows: list[dict]) -> None:
        names = [r["rule"] for r in rows]
        if len(set(names)) < len(names):
            raise ValueError("two rules have one name")
        self._write(self._version() + 1, rows)

    def create(self, rule: Rule) -> dict:
        """A rule under a name that no other has."""
        rows = self._rows()
        made = self._row(rule, max((r["created"] for r in rows), default=-1) + 1)
        self._save([*rows, made])
        return made

    def update(self, rule_id: str, **fields) -> dict:
        """Changes the given fields: None leaves one as it is, but empties a filter, as the empty text does."""
        rows, old = self._rows(), self.get(rule_id)
        filters = ("source_system_filter", "component_filter", "message_contains")
        changed = {k: (v or None) if k in filters else v for k, v in fields.items() if k in filters or v is not None}
        enabled = changed.pop("enabled", old["enabled"])
        own = {k: old[k] for k in asdict(SEEDS[0])} | changed
        new = self._row(Rule(**own), old["created"], enabled, rule_id)
        self._save([new if r["rule_id"] == rule_id else r for r in rows])
        return new

    def delete(self, rule_id: str) -> None:
        self._save([r for r in self._rows() if r["rule_id"] != rule_id])
