"""Operator 3: documents repeated so that sources reach target weights. DataFrame expressions only.

Sizes are summed for each source; a source's target is its share of the whole by weight, at most max_rate times its
size, and what that cuts off is shared out again by weight until no source is above. With sources in the order of
max_rate * size / weight this has a closed form: the first ones stop at their limit, the others share the rest.
The rate is target / size; a document is taken floor(rate) times, and once more where a hash of its id, uniform in
[0, 1), is below the fraction. So a rerun takes the same copies, and no row depends on another.

One row for each source, three numbers and its name, is ordered in one place: that holds for sources by the million,
which is more than a mixture with weights by source can mean; nothing that grows with the documents is. The join back to the documents is by Spark's choice: it
broadcasts the sources' table only where its size is below the session's threshold, else it splits skewed sources.

Defined cases: null and blank texts have size 0; a null source is a source, last in order; a source of size 0 has
target 0; rows that repeat a doc_id draw alike; a row without one draws by its text, so only equal texts do; an empty table gives no rows. Other columns
are kept by mix(), whatever their names are, and ignored by plan_mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, unit_hash, word_array

WEIGHTS = (5, 2, 1)


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = 3) -> DataFrame:
    """source, source_size, target, rate for rows with source and size. Weights repeat over sources by code point, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    limited = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_rate))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # What a unit of weight gets if all sources before this one stop at their limit and no other does.
    share = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    first_free = limited.withColumn("share", share).withColumn("level", F.min(F.when(F.col("most") >= F.col("share") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("by"), F.col("share").alias("share")))).over(whole)["share"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return first_free.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate: Column, key: Column, seed: str) -> Column:
    return (F.floor(rate) + F.when(unit_hash(seed, key) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _size(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def _draw() -> Column:
    """What a row draws by: its id, or where it has none a digest of its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))


def _rated(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], max_rate: int, seed: str) -> DataFrame:
    """rows (source, draw and others) with source_size, target, rate and copies, from the sizes of `sized`."""
    # Written, so that its true size decides whether the rows need a shuffle.
    rates = materialize(source_rates(sized, weights, max_rate)).select(F.struct("source").alias("of"), "source_size", "target", "rate")
    joined = rows.withColumn("of", F.struct("source")).join(rates, "of").drop("of")
    return joined.withColumn("copies", copies(F.col("rate"), F.col("draw"), seed))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for each row."""
    # Without texts the rows are few bytes each, so they are written and the texts are read once.
    rows = materialize(docs.select("doc_id", "source", _size(F.col("text")).alias("size"), _draw().alias("draw")))
    return _rated(rows, rows.select("source", "size"), weights, max_rate, seed).drop("draw")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """The documents, each as often as it is taken, in the columns of docs."""
    rows = docs.select("source", _draw().alias("draw"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = docs.select("source", _size(F.col("text")).alias("size"))
    taken = _rated(rows, sized, weights, max_rate, seed).where("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
