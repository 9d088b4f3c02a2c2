"""Connected components of a graph given by its edges, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of each node in edges (a, b) of any ordered type. Loops and nulls are left out.

    Each round hangs a node's larger neighbours, then its smaller ones, under the smallest it knows, until every
    component is one star around its smallest node; rounds grow as the logarithm of the nodes. Minima are aggregated before
    the shuffle and each round is written, so a lost executor repeats a round at most.
    """
    # up holds for each child a smaller parent.
    up = written(edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct())
    before = None
    while True:
        state = up.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("child", "parent")).alias("x")).first()
        if state == before or not state["n"]:
            return up.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(up.select("parent", "parent").distinct())
        before = state
        both = up.toDF("u", "v").union(up.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        first = hung.groupBy("child").agg(F.min("parent").alias("m"))
        moved = hung.join(first, "child").where("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        up = written(moved.union(first.toDF("child", "parent")).distinct())
