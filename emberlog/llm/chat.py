"""Operator 1: conversations to training text with a loss mask, by grammar round trip.

The template's grammar, for a whole conversation:

    conversation = { turn }
    turn         = "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

Role and body hold neither marker, the role holds no newline. In both, "<", any number of backslashes and "|" reads
as the same with one backslash less, and in the role "\\" "n" and "\\" "\\" stand for newline and backslash.
Each turn is first rendered as it is and read again by the deterministic parser; where the parser fails or
returns another turn, conflicting content is escaped once more, until the recovered turn is identical.

Formatting is row by row, before any shuffle. Positions, the whole text and its digests follow the order of the
turns: rows are dealt by conversation and sorted, and a task streams over them with a few counters and hash states.
So a conversation of any length takes constant memory; its digest is sequential by nature, and so is its task.

Defined cases: rows go by turn (nulls first), then role, then text; repeated rows are turns of their own; a null
role or text is empty; rows with a null conversation id form one conversation; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import own_columns

START, END = "<|im_start|>", "<|im_end|>"
_GUARDED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(s: str) -> str:
    return _GUARDED.sub(r"<\\\1|", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"<\1|", s)


def _escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s), flags=re.S)


def render(role: str, body: str) -> str:
    return f"{START}{role}\n{body}{END}\n"


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text. ValueError where it isn't in the grammar."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m or START in m[1] or END in m[1] or START in m[2] or END in m[2]:
            raise ValueError(f"no turn at {at}")
        turns.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its body begins and how long it is, in code points."""
    for head, body in ((role, text), (_escape_role(role), escape(text))):
        out = render(head, body)
        try:
            if parse(out) == [(role, text)]:
                return out, len(START) + len(head) + 1, len(body)
        except ValueError:
            pass
    raise AssertionError("one level of escapes restores any turn")


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, position, formatted, start, loss_start, loss_chars: a row for each turn.

    The formatted conversation is the concatenation of `formatted` by position; start counts its code points before
    the turn. The loss mask covers loss_chars code points from loss_start, in the whole text; none where null.
    """
    kind = dict(rows.dtypes)["conv_id"]
    slim = own_columns(rows, "conv_id", "turn", "role", "text")

    def turns(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [format_turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            mask = [(b, n) if r in loss_roles else (None, None) for r, (_, b, n) in zip(batch.column(2).to_pylist(), made)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in made], "string"), pa.array([x[0] for x in mask], "int64"), pa.array([x[1] for x in mask], "int64")], ["conv_id", "turn", "role", "formatted", "body_at", "body_chars"])

    def positions(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, position, start = object(), 0, 0
        for batch in batches:
            out: list[list] = [[], [], []]
            for conv, text, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if conv != now:
                    now, position, start = conv, 0, 0
                out[0].append(position)
                out[1].append(start)
                out[2].append(None if body is None else start + body)
                position, start = position + 1, start + len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], "int64"), batch.column(3), pa.array(out[1], "int64"), pa.array(out[2], "int64"), batch.column(5)], ["conv_id", "position", "formatted", "start", "loss_start", "loss_chars"])

    made = slim.mapInArrow(turns, f"conv_id {kind}, turn {dict(rows.dtypes)['turn']}, role string, formatted string, body_at long, body_chars long")
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "formatted")
    return ordered.mapInArrow(positions, f"conv_id {kind}, position long, formatted string, start long, loss_start long, loss_chars long")


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """A digest of each conversation, from the output of format_chats alone, in any order and partitions of its rows.

    The parser reads the conversation on from turn to turn: each row must go on where the last one ended and be whole
    turns of the grammar, so that the parts' turns are the whole's. ordered: the rows lie as format_chats() left them, so
    they needn't be dealt and sorted again; where they don't, the check fails.
    n_turns, turns_sha256 over role, newline, text, newline of each parsed turn, loss_chars and loss_sha256 over the
    unescaped text under the mask, formatted_chars.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [ids, "int64", "string", "int64", "string", "int64"])], names)

        ids = pa.int64()
        for batch in batches:
            ids = batch.schema.field(0).type
            for conv, position, text, start, loss_start, loss_chars in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if (position, start) != (state[5], state[4]):
                    raise ValueError(f"conversation {conv}: turn {position} doesn't follow")
                state[5] += 1
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if loss_start is not None:
                    masked = unescape(text[loss_start - start : loss_start - start + loss_chars])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    rows = formatted if ordered else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
