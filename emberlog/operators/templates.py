"""Templates of log messages, and a proposer of profiles that reads a sample's structure.

templates() is a parse tree of fixed depth as a grouping: messages with as many tokens and the same first tokens, numbers
apart, are one leaf. In a leaf a position with one token keeps it, others become a wildcard. A leaf's lines are merged in
each task before the only shuffle, which moves a text for each leaf and task: never tokens, never a group's rows.

propose() reads a sample of some dozen lines, which generate_profile() bounds and checks: it is a callable for it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.profiles import Profile

WILD = "<*>"
#: Tokens of the tree's path.
DEPTH = 2
#: Bytes of templates that a task holds before it passes them on, and what each of them counts beside its text.
HELD, HELD_EACH = 1 << 24, 200


def templates(events: DataFrame, text: str = "message", depth: int = DEPTH) -> DataFrame:
    """template, n, n_wild: templates of all texts with their number of rows. Null and blank texts have none.

    Tokens stand between blanks; one with a digit is a wildcard. Texts of different length have different templates.
    """
    digit, wild = re.compile(rb"[0-9]").search, WILD.encode()

    def both(a: bytes, b: bytes) -> bytes:
        return a if a == b else b" ".join([x if x == y else wild for x, y in zip(a.split(b" "), b.split(b" "))])

    def table(rows):
        import pyarrow as pa

        sizes, counts, texts = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(sizes, "int32"), pa.array(counts, "int64"), pa.array(texts, "binary")], ["size", "n", "template"])

    def within(batches):
        """Leaves of a task's lines. bytes.split() knows the same blanks: 20 and 09 to 0D."""
        held, size = {}, 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                tokens = line.split()
                if not tokens:
                    continue
                if digit(line):
                    tokens = [wild if digit(t) else t for t in tokens]
                leaf, whole = (len(tokens), *tokens[:depth]), b" ".join(tokens)
                if leaf in held:
                    n, other = held[leaf]
                    held[leaf] = n + 1, both(other, whole)
                    continue
                held[leaf] = 1, whole
                size += len(whole) + HELD_EACH
                if size > HELD:
                    yield table([(k[0], *v) for k, v in held.items()])
                    held, size = {}, 0
        yield table([(k[0], *v) for k, v in held.items()])

    def across(batches):
        """Leaves in their order: what tasks found of each is merged as it comes."""
        now = last = None
        for batch in batches:
            done = []
            for size, head, n, whole in zip(*(c.to_pylist() for c in batch.columns)):
                if (size, head) == now:
                    last = size, last[1] + n, both(last[2], whole)
                    continue
                if last:
                    done.append(last)
                now, last = (size, head), (size, n, whole)
            yield table(done)
        yield table([last] if last else [])

    shape = "size int, n long, template binary"
    found = events.where(F.col(text).isNotNull()).select(F.col(text).cast("binary")).mapInArrow(within, shape)
    # A template begins with its path, as that is the same in all of its lines.
    placed = found.select("size", F.substring_index(F.col("template").cast("string"), " ", depth).alias("head"), "n", "template")
    whole = placed.repartition("size", "head").sortWithinPartitions("size", "head").mapInArrow(across, shape)
    told = F.col("template").cast("string")
    return whole.select(told.alias("template"), "n", F.size(F.filter(F.split(told, " "), lambda t: t == WILD)).cast("long").alias("n_wild"))


#: Words that name a level.
LEVELS = {"TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "ERR", "CRIT", "CRITICAL", "FATAL", "ALERT", "EMERG", "SEVERE"}
#: Shapes of times, the longest first.
TIMES = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
    r"[A-Za-z]{3} [A-Za-z]{3} +\d{1,2} \d{2}:\d{2}:\d{2}(?:\.\d+)? \d{4}",
    r"[A-Za-z]{3} +\d{1,2} \d{2}:\d{2}:\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}",
)
_TIME = re.compile("|".join(TIMES))
#: Parts of a header: a time, what stands in brackets or quotes, a word with its colon, any other word.
_PART = re.compile(rf'(?P<time>\[?(?:{"|".join(TIMES)})\]?)|(?P<bracket>\[[^\]]*\])|(?P<quote>"[^"]*")|(?P<word>[^\s\[\]":]+(?:\[\d+\])?)(?P<colon>\s*:(?=\s|$))?')
#: Parts of a header at most.
MOST = 8


def _level(text: str) -> bool:
    return text.strip("[]").rsplit(":", 1)[-1].upper() in LEVELS


def _fields(values: dict[str, list[str]]) -> dict[str, str | None]:
    """Which field is the time, the level, the message and the component, by what their values look like."""

    def share(name: str, test) -> float:
        return sum(map(bool, map(test, values[name]))) / max(1, len(values[name]))

    rest = list(values)
    found: dict[str, str | None] = {}
    for role, test in (("timestamp", _TIME.match), ("level", _level)):
        best = max(rest, key=lambda n: share(n, test), default=None)
        found[role] = best if best is not None and share(best, test) >= 0.8 else None
        rest = [n for n in rest if n != found[role]]
    found["message"] = max(rest, key=lambda n: (sum(map(len, values[n])), n), default=None)
    rest = [n for n in rest if n != found["message"] and share(n, re.compile(r"[A-Za-z][\w.\-/]*$").match) >= 0.8]
    found["component"] = min(rest, key=lambda n: (len(set(values[n])), rest.index(n)), default=None)
    return found


def _documents(lines: list[str]) -> Profile | None:
    docs = []
    for line in lines:
        try:
            docs.append(json.loads(line))
        except ValueError:
            continue
    docs = [d for d in docs if isinstance(d, dict)]
    if len(docs) < 0.8 * len(lines):
        return None
    usual = Counter(k for d in docs for k in d)
    values = {k: [str(d[k]) for d in docs if isinstance(d.get(k), str)] for k, n in usual.items() if n >= 0.8 * len(docs)}
    roles = _fields({k: v for k, v in values.items() if v})
    if not roles["timestamp"]:
        return None
    return Profile("proposed", "json", "root", timestamp_field=roles["timestamp"], level_field=roles["level"] or "level", component_field=roles["component"], message_field=roles["message"] or "message")


def _table(lines: list[str]) -> Profile | None:
    import csv

    for d in (",", "\t", "|", ";"):
        rows = list(csv.reader(lines, delimiter=d))
        size, n = Counter(map(len, rows)).most_common(1)[0]
        rows = [r for r in rows if len(r) == size]
        if size < 3 or n < 0.8 * len(lines):
            continue
        roles = _fields({str(k): [r[k].strip() for r in rows] for k in range(size)})
        # A whole cell is the time; a comma within a sentence makes no table.
        if roles["timestamp"] is None or not all(_TIME.fullmatch(r[int(roles["timestamp"])].strip()) for r in rows[1:]):
            continue
        names = {v: k for k, v in roles.items() if v is not None}
        return Profile("proposed", "delimited", d, delimiter_fields=tuple(names.get(str(k), f"field_{k + 1}") for k in range(size)))
    return None


def _parts(line: str) -> list[tuple[str, str, str]]:
    """kind, text and the blanks before it, of a header's first parts."""
    out, at = [], 0
    while len(out) < MOST:
        gap = re.compile(r"\s*").match(line, at)
        m = _PART.match(line, gap.end())
        if not m or not m[0]:
            break
        kind = m.lastgroup
        if kind == "word" and m["word"].isupper() and _level(m["word"]):
            kind = "level"
        if kind == "bracket" and _level(m[0]):
            kind = "[level]"
        out.append((kind, m[0], gap[0]))
        at = m.end()
    return out


def _header(lines: list[str], shorter: int) -> Profile | None:
    """A pattern from the parts that nearly all lines have in the same place, as long as it holds for most of them."""
    read = [_parts(line) for line in lines]
    places: list[str] = []
    alive = read
    while len(places) < MOST:
        kinds = Counter(r[len(places)][0] for r in alive if len(r) > len(places))
        kind, n = kinds.most_common(1)[0] if kinds else ("", 0)
        if n < 0.9 * len(lines):
            break
        alive = [r for r in alive if len(r) > len(places) and r[len(places)][0] == kind]
        places.append(kind)
    # What follows the last part that isn't a plain word is the message.
    while places and places[-1] == "word":
        places.pop()
    places = places[: len(places) - shorter] if shorter else places
    if "time" not in places:
        return None
    pattern, names, known = "^", set(), {"level": r"(?P<level>\w+)", "[level]": r"\[(?:[\w.]+:)?(?P<level>\w+)\]"}
    for k, kind in enumerate(places):
        texts = [r[k][1] for r in alive]
        if k:
            pattern += r"\s+" if all(r[k][2] for r in alive) else r"\s*"
        name = f"field_{k + 1}"
        if kind == "time" and "timestamp" not in names:
            open_, close = (r"\[", r"\]") if all(t.startswith("[") for t in texts) else ("", "")
            pattern += f"{open_}(?P<timestamp>{'|'.join(t for t in TIMES if any(re.search(t, x) for x in texts))}){close}"
            names.add("timestamp")
        elif kind in ("level", "[level]") and "level" not in names:
            pattern += known[kind]
            names.add("level")
        elif kind in ("bracket", "[level]"):
            pattern += rf"\[(?P<{name}>[^\]]*)\]"
        elif kind == "quote":
            pattern += f'"(?P<{"message" if "message" not in names else name}>[^"]*)"'
            names.add("message")
        elif kind == "colon":
            pattern += rf"(?P<{'component' if 'component' not in names else name}>[^\s:\[]+)(?:\[\d+\])?\s*:"
            names.add("component")
        else:
            pattern += rf"(?P<{name}>\S+)"
    if "message" not in names:
        pattern += r"(?:\s*:)?\s*(?P<message>.*)$"
    return Profile("proposed", "regex", pattern, component_field="component" if "component" in names else None)


def propose(lines: list[str], complaints: list[str]) -> Profile:
    """A profile for a sample's lines; each complaint makes the next one's header a part shorter."""
    lines = [line.rstrip("\r") for line in lines if line.strip()]
    # Lines that go on with a record before them have no time near their start.
    heads = [line for line in lines if line.lstrip().startswith("{") or _TIME.search(line[:120])] or lines
    makers: list[Callable[[], Profile | None]] = [lambda: _documents(heads), lambda: _table(heads), *[lambda k=k: _header(heads, k) for k in range(MOST)]]
    made = [p for p in (m() for m in makers) if p] if heads else []
    if not made:
        raise ValueError("the sample has no structure that is known")
    return made[min(len(complaints), len(made) - 1)]
