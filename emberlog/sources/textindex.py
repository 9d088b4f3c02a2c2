"""A search index beside the event store: which files hold which three-letter pieces, so that a search reads few files.

A text that matches %term% holds every run of three characters of the term's literal parts, in lower case as ILIKE
compares. The index names the files of each such run; a search leaves out the indexed files that lack one of them and
looks through the others as before, so its rows are those of the full scan. Terms with no run of three literal
characters read all files; so does any search of files that aren't indexed yet.

Defined cases: null and empty texts have no runs; a store without events has an empty index; indexing twice adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.browse import like_pattern, matching
from emberlog.sources.files import EventStore

#: Columns that a search looks at.
SEARCHED = ("message", "raw", "component")
#: Characters of a text that are cut at once; pieces overlap by two.
PIECE = 4096
RUNS, INDEXED = "gram string, file string, attempt string", "file string, attempt string"
PATH = "_metadata.file_path"


def runs_of(text: Column) -> Column:
    """The distinct runs of three characters of a text, which should be short."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    run = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1), F.element_at(chars, i + 2)))
    return F.when(n >= 3, F.array_distinct(run)).otherwise(F.array().cast("array<string>"))


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards of a LIKE pattern."""
    parts, escaped = [""], False
    for c in pattern:
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c in "%_":
            parts.append("")
        else:
            parts[-1] += c
            escaped = False
    return [p for p in parts if p]


class TextIndex:
    """The index of a store. An indexing run writes its runs first and then the files they are of, which is the commit."""

    def __init__(self, store: EventStore):
        self.store, self.spark = store, store.spark
        base = store.events_path.rsplit("/", 1)[0]
        self.runs_path, self.indexed_path = f"{base}/text_runs", f"{base}/text_files"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def indexed(self) -> DataFrame:
        """file, attempt: of two runs that indexed a file the first by name counts."""
        return self._read(self.indexed_path, INDEXED).groupBy("file").agg(F.min("attempt").alias("attempt"))

    def update(self) -> int:
        """Indexes the files that aren't yet; how many.

        Names of files reach the driver, as they do in any scan; texts and runs don't.
        """
        stored, attempt = self._read(self.store.events_path, self.store.STORED), uuid.uuid4().hex
        if not stored.inputFiles():
            return 0
        new = [r["file"] for r in stored.select(F.col(PATH).alias("file")).distinct().join(self.indexed(), "file", "left_anti").collect()]
        if not new:
            return 0
        texts = stored.where(F.col(PATH).isin(new)).select(F.col(PATH).alias("file"), F.explode(F.array(*[F.lower(c) for c in SEARCHED])).alias("text"))
        cut = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")))
        pieces = texts.where("text <> ''").select("file", "text", cut.alias("k")).select("file", F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE + 2)).alias("piece"))
        runs = pieces.select("file", F.explode(runs_of(F.col("piece"))).alias("gram")).distinct()
        # Sorted by run, so that statistics of row groups lead a search to few of them.
        placed = runs.repartitionByRange("gram").sortWithinPartitions("gram", "file")
        placed.select("gram", "file", F.lit(attempt).alias("attempt")).write.mode("append").parquet(self.runs_path)
        self.spark.createDataFrame([(f, attempt) for f in new], INDEXED).coalesce(1).write.mode("append").parquet(self.indexed_path)
        return len(new)

    def without(self, term: str, literal: bool = False) -> list[str]:
        """Indexed files that can't hold the term."""
        lowered = self.spark.range(1).select(F.lower(F.lit(like_pattern(term, literal))).alias("p")).first()["p"]
        wanted = sorted({p[i : i + 3] for p in literal_parts(lowered) for i in range(len(p) - 2)})
        if not wanted:
            return []
        found = self._read(self.runs_path, RUNS).where(F.col("gram").isin(wanted)).join(self.indexed(), ["file", "attempt"])
        full = found.groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
        return [r["file"] for r in self.indexed().join(full, "file", "left_anti").select("file").collect()]

    def search(self, term: str, literal: bool = False, **filters) -> DataFrame:
        """The events that browse.matching(store.events(), search=term, ...) finds, from the files that may hold them."""
        return matching(self.store.events(without=self.without(term, literal)), search=term, literal=literal, **filters)
