"""Operator 2: repeated runs of lines, by winnowing over line hashes. DataFrame expressions only.

Lines are named by two independent 64-bit hashes. From each line on, the shortest run of lines with at least `least_chars` characters,
newlines counted, is a window; the smallest hash in it, the last of equals, is a fingerprint. Any run of so many
characters holds the window that begins with it, so two copies of a run always share a fingerprint: that is what
makes the minima a guarantee, whatever the lines' lengths. A hundred characters are under what fifty words take.

Fingerprints are counted over all documents. Only around those that occur twice are positions joined and extended
both ways: each window, forward and backward, with that fingerprint is compared by its whole content, that is by the
128 bits of its lines' hashes, hashed in order. The first
place of a window, by document and line, stays; a line is deleted when it lies in a window that occurred before. A
run is the union of its windows, so runs are found to their full length, against any earlier place, and no two places
are paired: windows meet in an aggregate with a map-side part, and rows that share a key only look up its first place.
Keys that a large share of all windows has are few, so they are looked up in a broadcast table; the rest by a join.

With `line_chars`, a line of so many characters is a window by itself too, forward and backward, beside the longer
ones: boilerplate of one line goes although its neighbours differ, while shorter lines go with their neighbours only.

What is shuffled are numbers for each line; texts are joined once with the deleted runs, to be rebuilt.

Defined cases: order is by doc_id (nulls first), then by a hash of the text, then by line; rows that repeat both are
one document and keep the same lines; null texts stay null, empty ones empty; runs within one document count as well;
lines differ by any character; an empty table gives no rows. Other columns are kept, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import look_up, materialize

LEAST_CHARS = 100
#: A line of so many characters, its newline not counted, is enough to be a repeat where single lines are asked for.
LINE_CHARS = 30


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def windows(docs: DataFrame, least_chars: int = LEAST_CHARS, line_chars: int | None = None) -> DataFrame:
    """doc_id, th, first, last, content (two hashes), fingerprint, at (its line): forward and backward windows. Positions count lines from 0."""
    whole = F.split("text", "\n")
    # Two rows with equal id and text are one document, so its lines count once.
    # The number in front seeds the second hash, so it doesn't follow the first.
    named = F.transform(whole, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), (F.length(x) + 1).cast("long").alias("n")))
    lines = _keyed(docs).where("text IS NOT NULL").select("doc_id", "th", F.posexplode(named).alias("p", "x"))
    lines = lines.groupBy("doc_id", "th", "p").agg(F.first("x").alias("x")).select("doc_id", "th", "p", "x.*")
    doc = Window.partitionBy("doc_id", "th")
    placed = lines.withColumn("stop", F.sum("n").over(doc.orderBy("p"))).withColumn("start", F.col("stop") - F.col("n"))
    ahead = doc.orderBy("start").rangeBetween(0, least_chars - 1)
    behind = doc.orderBy("stop").rangeBetween(1 - least_chars, 0)

    def over(frame: Window) -> list[Column]:
        return [F.collect_list(F.struct("h", "p", "g")).over(frame).alias("run"), (F.max("stop").over(frame) - F.min("start").over(frame)).alias("chars")]

    def content(h: Column, g: Column) -> list[Column]:
        return [F.xxhash64(h, F.size(h)).alias("content"), F.xxhash64(g, F.size(g)).alias("content2")]

    def made(frame: Window) -> DataFrame:
        w = placed.select("doc_id", "th", *over(frame)).where(F.col("chars") >= least_chars)
        least = F.array_min(F.transform("run", lambda x: F.struct(x["h"].alias("h"), (-x["p"]).alias("p"))))
        ends = w.select("doc_id", "th", F.col("run")[0]["p"].alias("first"), F.element_at("run", -1)["p"].alias("last"), *content(F.col("run.h"), F.col("run.g")), least.alias("least"))
        return ends.select("*", F.col("least.h").alias("fingerprint"), (-F.col("least.p")).alias("at")).drop("least")

    # A line that is a window alone is one in both directions.
    found = made(ahead).unionByName(made(behind).where("first < last"))
    if line_chars is None:
        return found
    # Lines of least_chars are windows already.
    alone = placed.where((F.col("n") > line_chars) & (F.col("n") < least_chars))
    single = content(F.array("h"), F.array("g"))
    return found.unionByName(alone.select("doc_id", "th", F.col("p").alias("first"), F.col("p").alias("last"), *single, F.col("h").alias("fingerprint"), F.col("p").alias("at")))


def deleted_runs(docs: DataFrame, least_chars: int = LEAST_CHARS, line_chars: int | None = None) -> DataFrame:
    """doc_id, th, runs: for each document with repeats its deleted runs as (first, last), in order and apart."""
    all_windows = materialize(windows(docs, least_chars, line_chars))
    # Many windows share a minimum at one place; what counts is another place with the same hash.
    where = F.struct("doc_id", "th", "at")
    repeated = all_windows.groupBy("fingerprint").agg(F.min(where).alias("lo"), F.max(where).alias("hi"), F.count("*").alias("n")).where("lo != hi").select("fingerprint", "n")
    candidates = look_up(all_windows, materialize(repeated), ["fingerprint"]).where("there").select("doc_id", "th", "first", "last", "content", "content2")
    candidates = materialize(candidates)
    place, whole = F.struct("doc_id", "th", "first"), ["content", "content2"]
    first = candidates.groupBy(*whole).agg(F.min(place).alias("origin"), F.max(place).alias("final"), F.count("*").alias("n")).where("origin != final").select(*whole, "origin", "n")
    again = look_up(candidates, materialize(first), whole).where(place != F.col("origin")).select("doc_id", "th", "first", "last").distinct()
    doc = Window.partitionBy("doc_id", "th").orderBy("first", "last")
    apart = again.withColumn("reach", F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))).withColumn("run", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(doc))
    merged = apart.groupBy("doc_id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _kept_text(text: Column, runs: Column) -> Column:
    """The text without the lines of its deleted runs."""
    lines = F.split(text, "\n")

    def build(lines: Column) -> Column:
        def piece(k: Column) -> Column:
            begin = F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["last"] + 1)
            end = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["first"])
            return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece)), "\n")

    return F.element_at(F.transform(F.array(lines), build), 1)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, line_chars: int | None = None) -> DataFrame:
    """The rows and columns of docs with text rebuilt, and a last column of what was deleted, null where nothing was.

    That column is called _runs; where docs has one of this name, another underscore goes in front.
    """
    runs = materialize(deleted_runs(docs, least_chars, line_chars)).select(F.struct("doc_id", "th").alias("key"), "runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).alias("key"))
    # One plan at every size: runs are a share of the documents, so they are never broadcast.
    joined = rows.join(runs.hint("merge"), "key", "left")
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(_kept_text(F.col("row.text"), F.col("runs")))
    name = "_runs"
    while name in docs.columns:
        name = "_" + name
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns], F.col("runs").alias(name))
