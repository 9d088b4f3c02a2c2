"""Operator 10: documents to token sequences of bounded length, packed best-fit.

Bounded-space online best-fit. Pieces arrive one by one; a fixed number of bins is open, and a bitset
over free space finds the fullest bin that still takes a piece in one step. When every bin is open and
none fits, the fullest closes. Memory for each task: the open bins, and one Arrow batch.

Defined cases: a null or empty text is the end token alone; a repeated row is packed once for each of its
rows; an empty table gives no row; other columns of the input are ignored. Longer documents alone are cut:
the first piece takes the odd part and all others are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, own_columns

#: Pieces for one packing task; more pieces mean more tasks, not longer ones.
PIECES_A_TASK = 200_000
#: Open bins of a packing task.
OPEN_BINS = 4096
#: Distinct words whose ids a worker remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED_WORDS = 400_000


class WordEncoder:
    """Ids of byte-level BPE, with the ids of each space-separated word kept.

    A single space between two characters that are no white space always starts a new unit of the tokenizer's own
    splitting, so both sides can be encoded apart. Where a space touches other white space the text stays whole there.
    Unknown words are encoded together in one text; the byte lengths of the tokens tell where each word ends.
    Texts that hold a special token's string go to the tokenizer as they are.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import numpy as np
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.widths = np.zeros(max(ranks.values()) + 1, "int64")
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        ids = np.array(self.plain(" " + " ".join(words)), "<u4")
        ends = np.cumsum(self.widths[ids])
        stops = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        raw, begin = ids.tobytes(), 0
        for w, stop in zip(words, (stops * 4).tolist()):
            self.later[w] = raw[begin:stop]
            begin = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        import numpy as np

        parts: list[list[str] | None] = []
        for t in texts:
            if any(s in t for s in self.special):
                parts.append(None)
                continue
            p = t.split(" ")
            if len(p) > 1 and ("" in p or any(x[0].isspace() or x[-1].isspace() for x in p)):
                p = self.cut(t)
            parts.append(p)
        got = [list(map(self.later.get, p[1:])) if p else [] for p in parts]
        unknown = {w for p, g in zip(parts, got) if None in g for w, ids in zip(p[1:], g) if ids is None}
        if unknown:
            if len(self.later) + len(unknown) > REMEMBERED_WORDS:
                self.later = {}
            self._learn(sorted(unknown))
            for p, g in zip(parts, got):
                if None in g:
                    g[:] = [self.later[w] if ids is None else ids for w, ids in zip(p[1:], g)]
        out = []
        for t, p, g in zip(texts, parts, got):
            if p is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                if (head := self.first.get(p[0])) is None:
                    head = np.array(self.plain(p[0]), "<u4").tobytes()
                    if len(self.first) < REMEMBERED_WORDS // 8 and len(p[0]) < 64:
                        self.first[p[0]] = head
                out.append(head + b"".join(g))
        return out


def pieces(docs: DataFrame, max_len: int = 1024, end_id: int = 2, tokenizer: tuple[str, str, str] | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: a row for each piece of at most max_len tokens."""
    if tokenizer is None:
        import public_tokenizers as P

        tokenizer = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = WordEncoder(*tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, number, starts, lengths, sums, ids = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode([x or "" for x in part.column(1).to_pylist()])):
                    raw += end
                    n = len(raw) // 4
                    bounds = [0, *range(n % max_len or max_len, n + 1, max_len)] if n > max_len else [0, n]
                    view = memoryview(raw)
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(i)
                        number.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(view[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(np.frombuffer(raw, "<u4")[a:b].astype("int32"))
                cols = {"doc_id": part.column(0).take(pa.array(rows, "int64")), "piece": pa.array(number, "int32"), "start": pa.array(starts, "int64"), "length": pa.array(lengths, "int64"), "ids_crc32": pa.array(sums, "int64")}
                yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    return own_columns(docs, id_col, text_col).mapInArrow(cut, schema)


class OpenBins:
    """A fixed number of open bins, found by free space through the bits of one integer."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece. The fullest bin that takes it; else a new one, for which the fullest closes if need be."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id = self.size, self.next_id
            self.next_id += 1
        if left := free - length:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
        return bin_id, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return bin_id


def pack(cut: DataFrame, max_len: int = 1024, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces(); their other columns stay.

    The pieces are dealt by document and piece in a hashed order, so neither a long document nor a hot source
    gathers in one task, and a rerun packs alike. Counting them needs a written table or another cheap plan.
    """
    tasks = max(1, -(-cut.count() // pieces_a_task))
    schema = cut.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    place = cut.schema.fieldNames().index("length")

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bins = OpenBins(max_len, open_bins, TaskContext.get().partitionId() << 36)
        for batch in batches:
            put = [bins.put(n) for n in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in put], "int64"), pa.array([x for _, x in put], "int64")], [*batch.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece")
    dealt = cut.repartition(tasks, "doc_id", "piece").sortWithinPartitions(order, "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInArrow(fill, schema)


def best_fit(docs: DataFrame, max_len: int = 1024, with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all documents with their place in packed sequences."""
    return pack(materialize(pieces(docs, max_len, with_ids=with_ids, **options)), max_len)
