"""One file from lines to stored events: choice of profile or format, parsing, summary, alerts; and which files are due."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import formats, profiles
from emberlog.operators.formats import Format
from emberlog.operators.profiles import Profile
from emberlog.sources.files import MAX_BYTES, EventStore, read_lines, scan_directory

#: Lines and records that a choice looks at; both are bounded, whatever the file's size.
SAMPLE_LINES, SAMPLE_RECORDS = 500, 200


class FileTooLarge(ValueError):
    """A file is above the limit."""


@dataclass
class Summary:
    """What became of a file."""

    batch_id: str | None
    file_name: str
    total_lines: int
    events: int
    parsed: int
    matched: str | None
    match_ratio: float
    warnings: list[str] = field(default_factory=list)


def sample(lines: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    return lines.orderBy("file_name", "line_no").limit(n)


def choose(lines: DataFrame, known: Iterable[Profile], ingested: Column, forced: str | None = None) -> tuple[Profile | Format | None, float, list[str]]:
    """A forced name; else the best profile; else a format that detects the sample; else the first profile with a warning."""
    known = list(known)
    if forced:
        found = profiles.profile_named(known, forced) or next((f for f in formats.formats() if forced.lower() in (f.name.lower(), f.key)), None)
        if found is None:
            raise KeyError(f"no profile or format is called {forced}")
        return found, 0.0, []
    # Read once; what follows looks at these few lines alone.
    taken = sample(lines.select("file_name", "line_no", "line")).collect()
    head = lines.sparkSession.createDataFrame(taken, "file_name string, line_no int, line string")
    best, ratio = profiles.best_profile(head, known, ingested, SAMPLE_LINES)
    if best:
        return best, ratio, []
    text = "\n".join(r["line"] for r in taken)
    fmt, warnings = formats.detect_format(text, formats.score_on(head))
    if fmt:
        return fmt, formats.score_on(head)(fmt), warnings
    return (known[0] if known else None), 0.0, ["No profile fits this file; it was read with the first one."]


def parse_file(lines: DataFrame, by: Profile | Format, ingested: Column) -> DataFrame:
    """Canonical events with `parsed`; events of formats are parsed where their time is known."""
    if isinstance(by, Profile):
        return profiles.parse(profiles.records_of(lines, by), by, ingested)
    return formats.canonical(by.records(lines), by, ingested).withColumn("parsed", F.col("ts_confidence") != "unparseable")


def ingest(spark: SparkSession, store: EventStore, path: str, known: Iterable[Profile] = profiles.DEFAULTS, forced: str | None = None, now: dt.datetime | None = None, on_batch: Callable[[DataFrame], None] | None = None, max_bytes: int | None = MAX_BYTES) -> Summary:
    """Reads a file into the store. An empty file makes no batch, one above max_bytes is an error. on_batch gets the stored events, for alerts."""
    found = spark.read.format("binaryFile").load(path).select("length").first()
    size = found["length"] if found else 0  # an empty file makes no row
    if max_bytes is not None and size > max_bytes:
        raise FileTooLarge(f"{path} has {size} bytes, more than {max_bytes}")
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    lines = read_lines(spark, path)
    name = path.rsplit("/", 1)[-1]
    total = lines.count()
    if not lines.where(F.trim("line") != "").limit(1).count():
        return Summary(None, name, total, 0, 0, None, 0.0, ["The file has no lines."])
    ingested = F.lit(now).cast("timestamp")
    by, ratio, warnings = choose(lines, known, ingested, forced)
    if by is None:
        raise ValueError("there are no profiles")
    events = parse_file(lines, by, ingested)
    batch = store.add(events.drop("parsed", "correlation_id"), name, size, by.name, ratio, at=now)
    counts = store.counts[batch]
    if on_batch:
        on_batch(store.events(batch))
    return Summary(batch, name, total, counts["events"], counts["timed"], by.name, round(ratio, 3), warnings)


@dataclass
class DirectorySummary:
    """What became of the files below a folder, in order of path."""

    ingested: list[Summary] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def ingest_directory(spark: SparkSession, store: EventStore, path: str, recursive: bool = True, max_bytes: int = MAX_BYTES, **options) -> DirectorySummary:
    """Reads each file of a folder whose extension is known. A file that fails or is too large doesn't stop the others.

    FileNotFoundError where nothing below the path has a known extension. The loop is over files, each a job of its own.
    """
    out = DirectorySummary()
    for f in scan_directory(spark, path, recursive, max_bytes).toLocalIterator():
        if f["verdict"] == "skipped":
            out.skipped.append(f["path"])
            continue
        try:
            out.ingested.append(ingest(spark, store, f["path"], max_bytes=max_bytes, **options))
        except Exception as e:  # reported, as one file must not hide the others
            out.errors.append(f"{f['path']}: {e}".splitlines()[0])
    if not out.ingested and not out.errors:
        raise FileNotFoundError(f"no file that can be read below {path}")
    return out


def ingest_samples(spark: SparkSession, store: EventStore, folder: str, **options) -> list[Summary]:
    """The sample files of a folder: JSON lines first, then logs, each by name. No alerts are evaluated."""
    files = [r["path"] for r in scan_directory(spark, folder, recursive=False).collect()]
    ordered = [f for e in (".jsonl", ".log") for f in files if f.endswith(e)]
    if not ordered:
        raise FileNotFoundError(f"no samples in {folder}")
    return [ingest(spark, store, f, **(options | {"on_batch": None})) for f in ordered]


def profile_sample(lines: DataFrame, head: int = 20, tail: int = 20, some: int = 10, seed: int = 7) -> DataFrame:
    """Lines to describe a file by: its first, its last, and some between in a seeded order. Each part is a top-k, not a sort of the file."""
    first = lines.orderBy("line_no").limit(head)
    last = lines.orderBy(F.desc("line_no")).limit(tail)
    rest = lines.orderBy(F.xxhash64("line_no", F.lit(seed)), "line_no").limit(some)
    return first.unionByName(last).unionByName(rest).dropDuplicates(["file_name", "line_no"]).orderBy("file_name", "line_no")


def check_profile(profile: Profile, lines: DataFrame, ingested: Column) -> list[str]:
    """What is wrong with a new profile: its pattern, its fields, or how little of the sample it reads."""
    import re

    if profile.type not in ("regex", "json", "delimited"):
        return [f"no such type: {profile.type}"]
    if profile.type == "regex":
        try:
            groups = re.compile(profile.pattern).groupindex
        except re.error as e:
            return [f"pattern: {e}"]
        if profile.timestamp_field not in groups:
            return [f"the pattern has no group {profile.timestamp_field}"]
    ratio = profiles.match_ratio(sample(lines), profile, ingested, SAMPLE_RECORDS)
    return [] if ratio >= profile.min_match_ratio else [f"it reads {ratio:.0%} of the sample"]


def generate_profile(lines: DataFrame, ingested: Column, propose: Callable[[list[str], list[str]], Profile], attempts: int = 3) -> Profile:
    """A profile from a proposer (sample lines, complaints so far), checked each time; ValueError when none holds."""
    text, complaints = [r["line"] for r in profile_sample(lines).collect()], []
    for _ in range(attempts):
        made = propose(text, complaints)
        wrong = check_profile(made, lines, ingested)
        if not wrong:
            return made
        complaints += wrong
    raise ValueError("; ".join(complaints))


def changed(listing: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files (path, size, modified) to read, with the offset to start at and whether they were rotated.

    Unchanged size and time: left out; grown: from the bytes read before; shrunk: from the beginning.
    """
    known = checkpoints.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("bytes_read").alias("_read"))
    rows = listing.join(known, "path", "left").where(F.col("_size").isNull() | (F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")))
    rotated = F.coalesce(F.col("size") < F.col("_read"), F.lit(False))
    return rows.select("path", "size", "modified", F.when(rotated, F.lit(0)).otherwise(F.coalesce("_read", F.lit(0))).cast("long").alias("offset"), rotated.alias("rotated"))


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled sources that were never polled or whose interval has passed: enabled, last_polled, interval_minutes."""
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_polled") >= F.col("interval_minutes") * 60
    return sources.where(F.col("enabled") & (F.col("last_polled").isNull() | waited))
