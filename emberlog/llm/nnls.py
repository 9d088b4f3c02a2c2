"""Operator 11: token sequences packed by non-negative least squares over a histogram of lengths.

Documents are cut into full windows and a rest shorter than one. Combinations of up to `depth` lengths that fill a window exactly are
enumerated, and how often each is to be used is the non-negative least-squares solution of (lengths in combinations) x (repeats) =
histogram. Its solver keeps a set of combinations that is free (an active-set method), so that few combinations are used often and
rounding costs little. Rounded counts never exceed what is there. The rests that remain are packed greedily in tasks of bounded size: the longest
one that fits, and where none fits the shortest longer one is cut. A task's last tokens fill windows of powers of two, so nothing is padded.

Only the histogram, at most one row for each length below a window, reaches the driver, and only the slots of used combinations
are broadcast: at most `depth` for each of MOST_FREE combinations, whatever the corpus holds. Each rest finds its slot by its place
among the rests of its length (ranks.numbered), so a length that a third of all documents have is dealt like any other.

Defined cases: a null or empty text is the end token alone; a repeated row is packed once for each of its rows; an empty table gives no row; other
columns of the input are ignored. Each id lies in exactly one piece. Numbers of sequences are any; they don't repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, own_columns
from emberlog.llm.packing import WordEncoder
from emberlog.llm.ranks import numbered

if TYPE_CHECKING:
    import numpy as np

#: Combinations that the solver keeps free at most: more unknowns than lengths fit no histogram better.
MOST_FREE = 2048
#: Rests for one task of the greedy part; more rests mean more tasks.
RESTS_A_TASK = 65_536
#: Cut rests whose keys are broadcast; beyond that the join with their ids shuffles both sides.
BROADCAST_CUTS = 500_000


def windows(docs: DataFrame, max_len: int = 1024, end_id: int = 0, tokenizer: tuple[str, str, str] | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written row for each full window and each rest: key (unique), doc_id, start, length, ids_crc32, doc_tokens, ids.

    ids: little-endian unsigned 32-bit numbers, null for full windows, which are never cut, unless keep_ids.
    """
    if tokenizer is None:
        import public_tokenizers as P

        tokenizer = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encoder, end = WordEncoder(*tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode([x or "" for x in part.column(1).to_pylist()])):
                    raw += end
                    n = len(raw) // 4
                    for a in range(0, n, max_len):
                        piece = raw[4 * a : 4 * (a + max_len)]
                        rows.append(i)
                        starts.append(a)
                        lengths.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        totals.append(n)
                        ids.append(piece if keep_ids or len(piece) < 4 * max_len else None)
                numbers = [pa.array(x, "int64") for x in (starts, lengths, sums, totals)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, "int64")), *numbers, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return materialize(own_columns(docs, id_col, text_col).mapInArrow(cut, schema).withColumn("key", F.monotonically_increasing_id()))


def combinations(lengths: np.ndarray, size: int, depth: int = 3) -> np.ndarray:
    """Ascending lengths of 2 to `depth` rests that fill a window, a row each; unused places are 0."""
    import numpy as np

    there = np.zeros(size + 1, bool)
    there[lengths] = True
    tails = lengths[:, None].astype("int64")
    found = []
    for n in range(2, depth + 1):
        last = size - tails.sum(axis=1)
        done = (last >= tails[:, -1]) & there[np.clip(last, 0, size)]
        full = np.c_[tails[done], last[done]]
        found.append(np.pad(full, ((0, 0), (0, depth - n))))
        if n < depth:
            longer = np.repeat(tails, len(lengths), axis=0)
            more = np.tile(lengths, len(tails))
            fits = (more >= longer[:, -1]) & (longer.sum(axis=1) + 2 * more <= size)
            tails = np.c_[longer[fits], more[fits]]
    return np.concatenate(found)


def least_squares(combos: np.ndarray, counts: np.ndarray, tolerance: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Repeats x >= 0 of combinations that come nearest to the counts of lengths, by an active-set method that frees several at once.

    In each round the combinations with the steepest descent that share no length are freed, the least-squares
    solution over the free ones is found, and those that would be negative are held at 0 until none is. The best round counts;
    the search ends where nothing descends or five rounds bring the squared error down by less than a thousandth.
    """
    import numpy as np

    size, m = len(counts), len(combos)
    target = counts.astype(float)
    target[0] = 0
    x, free, left = np.zeros(m), np.zeros(0, "int64"), target
    errors = [float(target @ target)]
    for _ in range(rounds):
        slope = left[combos].sum(axis=1)
        slope[free] = 0
        steep = np.argsort(-slope, kind="stable")[:4096]
        taken, fresh = np.zeros(size, bool), []
        for k in steep[slope[steep] > tolerance * target.max()]:
            used = combos[k][combos[k] > 0]
            if not taken[used].any():
                taken[used] = True
                fresh.append(k)
        free = np.r_[free, fresh[: MOST_FREE - len(free)]].astype("int64")
        if not fresh:
            break
        while True:
            a = np.zeros((size, len(free)))
            for place in range(combos.shape[1]):
                np.add.at(a, (combos[free, place], np.arange(len(free))), 1.0)
            a[0] = 0
            z = np.linalg.solve(a.T @ a + 1e-8 * np.eye(len(free)), a.T @ target)
            if (z > 0).all():
                break
            free = free[z > 0]
        left = target - a @ z
        error = float(left @ left)
        if error < min(errors):
            x[:] = 0
            x[free] = z
        errors.append(error)
        if np.abs(left).sum() <= tolerance * target.sum() or (len(errors) > 5 and min(errors[-5:]) > 0.999 * min(errors[:-5])):
            break
    return x


def plan(histogram: dict[int, int], size: int, depth: int = 3) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first, stop, sequence, offset): of the rests of a length, those from place first up to stop go one by one into sequences from `sequence` on, at that offset."""
    import numpy as np

    counts = np.zeros(size + 1, "int64")
    for length, n in histogram.items():
        counts[length] = n
    combos = combinations(np.flatnonzero(counts), size, depth)
    if not len(combos):
        return []
    x = least_squares(combos, counts)
    used, begin, slots = np.zeros(size + 1, "int64"), 0, []
    for k in np.argsort(-x, kind="stable")[: np.count_nonzero(x)]:
        lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        repeats = int(min(np.rint(x[k]), ((counts - used)[lengths] // times).min()))
        if repeats < 1:
            continue
        at = 0
        for length in combos[k][combos[k] > 0].tolist():
            slots.append((length, int(used[length]), int(used[length]) + repeats, begin, at))
            used[length] += repeats
            at += length
        begin += repeats
    return slots


def fill(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Places for pieces of less than a window: (piece, from, length, sequence, offset), whole or cut. All sequences are full, but for the last ones, which are powers of two."""
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    bits = 0
    for k, n in enumerate(lengths):
        stacks[n].append((k, 0))
        bits |= 1 << n
    total = sum(lengths)
    last = total % size
    targets = [size] * (total // size) + [1 << b for b in reversed(range(last.bit_length())) if last >> b & 1]
    out = []
    for sequence, room in enumerate(targets):
        at = 0
        while at < room:
            left = room - at
            n = (bits & ((1 << (left + 1)) - 1)).bit_length() - 1
            if n <= 0:
                over = bits >> (left + 1)
                n = left + (over & -over).bit_length()
            piece, begin = stacks[n].pop()
            if not stacks[n]:
                bits &= ~(1 << n)
            took = min(n, left)
            if n > took:
                stacks[n - took].append((piece, begin + took))
                bits |= 1 << (n - took)
            out.append((piece, begin, took, sequence, at))
            at += took
    return out


def _greedy(rests: DataFrame, max_len: int, tasks: int) -> DataFrame:
    """Rests dealt over tasks and filled there: key, doc_id, start, length, ids_crc32 (null if cut), doc_tokens, sequence_id, offset, skipped (ids of the rest before the piece)."""
    kind = dict(rests.dtypes)["doc_id"]
    schema = f"key long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, skipped long"

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        lengths = rows["length"].to_numpy()
        piece, begin, took, sequence, at = np.array(fill(lengths.tolist(), max_len), "int64").T
        first = TaskContext.get().partitionId() << 33
        picked = rows.take(pa.array(piece))
        whole = pa.array(took == lengths[piece])
        sums = pa.compute.if_else(whole, picked["ids_crc32"].combine_chunks(), pa.scalar(None, "int64"))
        cols = [picked["key"], picked["doc_id"], pa.array(picked["start"].to_numpy() + begin), pa.array(took), sums, picked["doc_tokens"], pa.array(4 * (first + sequence) + 2), pa.array(at), pa.array(begin)]
        yield from pa.Table.from_arrays(cols, ["key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "skipped"]).to_batches(65536)

    dealt = rests.select("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens").repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(place, schema)


def sliced(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (key, skipped, length and others) with ids (array of int) and ids_crc32 of the piece, read from the table of windows."""
    others = [c for c in rows.columns if c not in ("ids_crc32", "ids")]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in others) + ", ids array<int>, ids_crc32 long"
    if rows.isEmpty():
        return rows.select(*others, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("long").alias("ids_crc32"))
    few = rows.select(*others)
    joined = cut.select("key", F.col("ids").alias("_ids")).join(F.broadcast(few) if rows.count() <= BROADCAST_CUTS else few, "key").select(*others, "_ids")

    def read(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            skipped, length = batch.column(others.index("skipped")).to_pylist(), batch.column(others.index("length")).to_pylist()
            parts = [raw[4 * a : 4 * (a + n)] for raw, a, n in zip(batch.column(len(others)).to_pylist(), skipped, length)]
            ids = pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array([zlib.crc32(p) for p in parts], "int64")], [*others, "ids", "ids_crc32"])

    return joined.mapInArrow(read, schema)


def pack_by_histogram(docs: DataFrame, max_len: int = 1024, depth: int = 3, rests_a_task: int = RESTS_A_TASK, with_ids: bool = False, **options) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for: a row for each piece.

    The number of combinations grows as max_len ** (depth - 1); for windows above some thousand tokens take a depth of 2.
    """
    cut = windows(docs, max_len, keep_ids=with_ids, **options)
    named = ["key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut.where(F.col("length") == max_len).select(*named, (F.col("key") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = materialize(numbered(cut.where(F.col("length") < max_len).select(*named), ["length"], ["key"]).drop("n"))
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, max_len, depth)
    chosen = docs.sparkSession.createDataFrame(slots, "length long, first long, stop long, sequence long, offset long")
    met = (rests["length"] == chosen["length"]) & (rests["place"] >= chosen["first"]) & (rests["place"] < chosen["stop"])
    placed = rests.join(F.broadcast(chosen), met, "left").select(*[rests[c] for c in named], (4 * (F.col("sequence") + F.col("place") - F.col("first")) + 1).alias("sequence_id"), "offset")
    planned = placed.where("sequence_id IS NOT NULL")
    n = sum(histogram.values()) - sum(stop - first for _, first, stop, _, _ in slots)
    greedy = materialize(_greedy(placed.where("sequence_id IS NULL"), max_len, max(1, -(-n // rests_a_task))))
    out = [*named, "sequence_id", "offset"]
    zero = F.lit(0).cast("long").alias("skipped")
    if with_ids:
        every = full.select(*out, zero).union(planned.select(*out, zero)).union(greedy.select(*out, "skipped"))
        return sliced(every, cut).select(*out[1:], "ids")
    whole = full.select(*out).union(planned.select(*out)).union(greedy.where("ids_crc32 IS NOT NULL").select(*out))
    pieces = sliced(greedy.where("ids_crc32 IS NULL"), cut)
    return whole.union(pieces.select(*out)).drop("key")
