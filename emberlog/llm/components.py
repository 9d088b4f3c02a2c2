"""Connected components of an edge table, by contraction.

In each round every node is contracted into the first member of its closed neighbourhood; edges follow, loops and
doubles go. In the first round the smallest node is the first, so stars around their smallest node go at once; later on
it is that with the smallest hash, drawn anew for the round. Rounds grow as the logarithm of the nodes, whatever the
shape. Minima are aggregated before the shuffle, and tables are written between rounds, so a
lost executor repeats a round at most. Nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for each node of the edges (a, b), of any type that has an order. Nulls and loops are left out."""
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(maps))

        def ranked(name: str):
            return F.struct((F.xxhash64(name, seed) if maps else F.lit(0).cast("long")).alias("h"), F.col(name).alias("x"))

        arcs = left.select("a", "b").union(left.select("b", "a"))
        best = arcs.groupBy("a").agg(F.min(ranked("b")).alias("near"))
        into = materialize(best.select(F.col("a").alias("node"), F.least("near", ranked("a"))["x"].alias("into")))
        maps.append(into)
        a, b = into.toDF("a", "ra"), into.toDF("b", "rb")
        moved = left.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = materialize(moved.where("a < b").distinct())
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    labels = maps[0]
    for later in maps[1:]:
        step = later.toDF("into", "next")
        labels = labels.join(step, "into", "left").select("node", F.coalesce("next", "into").alias("into"))
    labels = materialize(labels)
    least = labels.groupBy("into").agg(F.min("node").alias("component"))
    return materialize(labels.join(least, "into").select("node", "component"))
