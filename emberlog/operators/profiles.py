"""Declarative parser profiles: records to canonical events, and which profile fits a file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.levels import normalize_level
from emberlog.functions.once import once
from emberlog.functions.times import parse_time
from emberlog.operators.grouping import group_lines, opens_record


@dataclass(frozen=True)
class Profile:
    """How a format's records are read. pattern: a regular expression with named groups, or the delimiter."""

    name: str
    type: str
    pattern: str = ""
    timestamp_field: str = "timestamp"
    timestamp_format: str | None = None
    level_field: str = "level"
    component_field: str | None = "component"
    message_field: str = "message"
    source_system_field: str | None = None
    default_source_system: str = "generic_vendor"
    timezone: str | None = "UTC"
    multiline_mode: str = "starts_with_timestamp"
    multiline_pattern: str | None = None
    min_match_ratio: float = 0.8
    level_map: dict[str, str] = field(default_factory=dict)
    delimiter_fields: tuple[str, ...] = ()


#: Status codes of an access log and their level.
_STATUS = {c: "INFO" for c in ("200", "201", "204", "301", "302", "304")} | {c: "WARN" for c in ("400", "401", "403", "404")} | {c: "ERROR" for c in ("500", "502", "503", "504")}
#: The profiles that every installation starts with.
DEFAULTS = (
    Profile("Apache Access Log", "regex", r'^(?P<ip>\S+) \S+ \S+ \[(?P<timestamp>[^\]]+)\] "(?P<message>(?P<method>\S+) (?P<path>\S+) [^"]+)" (?P<status>\d{3}) (?P<bytes>\S+)', level_field="status", component_field="method", default_source_system="apache", level_map=_STATUS),
    Profile("Standard Syslog", "regex", r"^(?P<timestamp>[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(?P<host>\S+)\s+(?P<component>[^\[:]+)(?:\[(?P<pid>\d+)\])?:\s+(?P<message>.*)$", source_system_field="host", default_source_system="syslog"),
    Profile("Application JSON Log", "json", "root", component_field="service", default_source_system="app_backend"),
    Profile("Delimited CSV/TSV Log", "delimited", ",", default_source_system="csv_export", delimiter_fields=("timestamp", "level", "component", "message")),
    Profile("Apache Error Log", "regex", r"^\[(?P<timestamp>[^\]]+)\]\s+\[(?:[\w.]+:)?(?P<level>\w+)\]\s+(?:\[pid\s+\d+:\w+\s+\d+\]\s+)?(?:\[client\s+(?P<client>[^\]]+)\]\s+)?(?P<message>.*)$", component_field=None, source_system_field="client", default_source_system="apache_server", level_map={"NOTICE": "INFO", "WARN": "WARN", "ERROR": "ERROR", "CRIT": "CRITICAL", "ALERT": "CRITICAL", "EMERG": "CRITICAL"}),
    Profile("Spring Boot / Java Microservice Log", "regex", r"^(?P<timestamp>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(?P<level>[A-Z]+)\s+(?P<pid>\d+)?\s*---\s*\[(?P<thread>[^\]]+)\]\s+(?P<component>[\w.]+)\s*:\s*(?P<message>.*)$", default_source_system="springboot_app"),
    Profile("Standard Bracket [TIMESTAMP] [LEVEL]", "regex", r"^(?:\[)?(?P<timestamp>\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)(?:\])?\s*\[(?P<level>\w+)\]\s*(?:\[(?P<component>[^\]]+)\])?\s*:?\s*(?P<message>.*)$", default_source_system="generic_app"),
)


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern for Spark, with the numbers of its named groups. Names are dropped, as Java allows fewer."""
    groups = dict(re.compile(pattern).groupindex)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{groups[m[1]]}", plain)
    return f"(?U)(?d){plain}", groups


#: Separates the groups of a match; log lines are read without it.
_NUL = "\x00"


def _read(profile: Profile, header: Column) -> Column:
    """What a profile makes of a header, each part computed once: fits, fields (map of texts), attributes (JSON text)."""

    def result(fits: Column, fields: Column, attributes: Column) -> Column:
        nothing = F.create_map().cast("map<string,string>")
        return F.struct(fits.alias("fits"), F.when(fits, fields).otherwise(nothing).alias("fields"), F.when(fits, attributes).otherwise("{}").alias("attributes"))

    if profile.type == "regex":
        pattern, groups = java_pattern(profile.pattern)
        flags, plain = pattern[:8], pattern[8:]
        # One match for all groups: the whole line is replaced by them.
        whole = f"{flags}^(?s:.*?)(?:{plain})(?s:.*)$"
        bare = F.translate(header, _NUL, "")
        parts = F.when(bare.rlike(pattern), F.split(F.regexp_replace(bare, whole, _NUL.join(f"${i}" for i in groups.values())), _NUL, -1))
        names = F.array(*[F.lit(g) for g in groups]) if groups else F.array().cast("array<string>")

        def of(parts: Column) -> Column:
            return once(F.map_from_arrays(names, F.slice(parts, 1, max(1, len(groups)))) if groups else F.create_map().cast("map<string,string>"), lambda m: result(parts.isNotNull(), m, F.to_json(m)))

        return once(parts, of)
    if profile.type == "json":
        wanted = sorted({f for f in (profile.timestamp_field, profile.level_field, profile.component_field, profile.message_field, profile.source_system_field) if f})

        def of_doc(doc: Column) -> Column:
            pairs = [x for f in wanted for x in (F.lit(f), F.try_variant_get(doc, f'$["{f}"]', "string"))]
            return result(doc.isNotNull(), F.create_map(*pairs), header)

        return once(F.when(header.rlike(r"^\s*\{"), F.try_parse_json(header)), of_doc)

    def of_cells(cells: Column) -> Column:
        names = profile.delimiter_fields
        keys = F.array(*[F.lit(n) for n in names]) if names else F.transform(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))
        fits = ~header.rlike(r"^\s*[\[{]") & (F.size(cells) == len(names) if names else F.size(cells) > 0)
        pairs = F.map_from_arrays(keys, F.when(F.size(cells) == F.size(keys), cells))
        return once(F.when(fits, pairs), lambda m: result(F.coalesce(fits, F.lit(False)), m, F.to_json(m)))

    return once(_cells(profile, header), of_cells)


def _cells(profile: Profile, line: Column) -> Column:
    """The cells of a delimited row, as many as it has. Within quotes a delimiter is text and two quotes are one."""
    delimiter = profile.pattern if profile.pattern in (",", "\t", "|", ";") else ","
    d = re.escape(delimiter)
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'(?s){d}("(?:[^"]|"")*"[^{d}]*|[^{d}]*)'), F.lit(1))

    def bare(c: Column) -> Column:
        return F.when(c.rlike(r'(?s)^".*"$'), F.replace(F.regexp_replace(c, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).otherwise(F.nullif(c, F.lit("")))

    return F.transform(cells, bare)


def parse(records: DataFrame, profile: Profile, ingested: Column, lenient: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns for each record, and parsed: whether the profile fits and the time is known. No record is dropped."""
    groups = list(java_pattern(profile.pattern)[1]) if profile.type == "regex" else None
    raw, none = F.col("raw"), F.lit(None).cast("string")

    def value(name: str | None) -> Column:
        return F.try_element_at(F.col("_f.fields"), F.lit(name)) if name else none

    def given(name: str) -> bool:
        """Whether records of this profile can have the field at all."""
        return name in (groups if groups is not None else profile.delimiter_fields or (name,))

    fits = F.col("_f.fits")
    read = records.withColumn("_f", _read(profile, F.col("header")))
    ts_raw = F.coalesce(value(profile.timestamp_field), F.lit(""))
    rows = read.withColumn("_time", parse_time(ts_raw, ingested, profile.timezone, profile.timestamp_format, lenient))
    message = F.coalesce(value(profile.message_field), raw)
    if profile.type != "delimited":
        follows = F.when(fits & (F.size("continuation") > 0), F.concat(F.lit("\n"), F.array_join("continuation", "\n"))).otherwise("")
        message = F.concat(message, follows) if given(profile.message_field) else F.when(fits, F.concat(raw, follows)).otherwise(raw)
    component = F.coalesce(value(profile.component_field), F.when(fits & F.lit(profile.type != "regex"), "")) if profile.component_field else none
    return rows.select(
        "file_name",
        "line_no",
        F.col("_time.ts").alias("ts_utc"),
        F.coalesce(F.nullif(ts_raw, F.lit("")), F.substring("header", 1, 50)).alias("ts_raw"),
        F.col("_time.confidence").alias("ts_confidence"),
        normalize_level(value(profile.level_field), profile.level_map).alias("level"),
        F.coalesce(F.nullif(value(profile.source_system_field), F.lit("")), F.lit(profile.default_source_system)).alias("source_system"),
        component.alias("component"),
        message.alias("message"),
        raw.alias("raw"),
        F.col("_f.attributes").alias("attributes"),
        (fits & (F.col("_time.confidence") != "unparseable")).alias("parsed"),
        *keep,
    )


def records_of(lines: DataFrame, profile: Profile | None, compat: bool = False) -> DataFrame:
    """Records by a profile's rules. A line that fits the profile itself opens a record too, unless compat asks for the narrow rules with records that end every 1000 lines."""
    return group_lines(lines, start_of(profile, compat), 1000 if compat else None)


def start_of(profile: Profile | None, compat: bool = False) -> Column:
    """True where a line opens a record, an expression over `line`."""
    if profile is None:
        return opens_record(F.col("line"))
    own = java_pattern(profile.pattern)[0] if profile.type == "regex" and not compat else (r"^\s*\{" if profile.type == "json" and not compat else None)
    start = opens_record(F.col("line"), profile.multiline_mode, profile.multiline_pattern, own)
    if profile.type == "delimited" and not compat:
        start = start | _read(profile, F.col("line"))["fits"]
    return start


def match_ratio(lines: DataFrame, profile: Profile, ingested: Column, sample: int = 200) -> float:
    """The share of the first records that the profile reads with a known time."""
    head = records_of(lines, profile).orderBy("file_name", "line_no").limit(sample)
    return float(parse(head, profile, ingested).agg(F.avg(F.col("parsed").cast("int")).alias("r")).first()["r"] or 0.0)


def best_profile(lines: DataFrame, profiles: Iterable[Profile], ingested: Column, sample_lines: int = 500) -> tuple[Profile | None, float]:
    """The profile with the highest ratio among those that reach their own minimum; of equals the first. The sample is bounded."""
    head = lines.orderBy("file_name", "line_no").limit(sample_lines)
    best: tuple[Profile | None, float] = (None, 0.0)
    for p in profiles:
        ratio = match_ratio(head, p, ingested)
        if ratio >= p.min_match_ratio and (best[0] is None or ratio > best[1]):
            best = (p, ratio)
    return best


def load_profiles(folder: str) -> tuple[list[Profile], list[str]]:
    """Profiles from a local folder of JSON files, seeded with the defaults; and warnings about files that can't be read."""
    base, found, warnings = Path(folder), [], []
    base.mkdir(parents=True, exist_ok=True)
    for p in DEFAULTS:
        if not (base / f"{slug(p.name)}.json").exists():
            save_profile(folder, p)
    for f in sorted(base.glob("*.json")):
        try:
            data = json.loads(f.read_text())
            data["delimiter_fields"] = tuple(data.get("delimiter_fields") or ())
            found.append(Profile(**data))
        except (ValueError, TypeError) as e:
            warnings.append(f"{f.name}: {e}")
    return found, warnings


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower().strip()).strip("_")


def save_profile(folder: str, profile: Profile, replace: bool = True) -> None:
    path = Path(folder) / f"{slug(profile.name)}.json"
    if path.exists() and not replace:
        raise FileExistsError(profile.name)
    path.write_text(json.dumps(asdict(profile), indent=2))


def profile_named(profiles: Iterable[Profile], name: str) -> Profile | None:
    return next((p for p in profiles if p.name.lower() == name.lower()), None)
