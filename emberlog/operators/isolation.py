"""Isolation forest: how soon random cuts part a row from the others.

Trees are fitted on bounded samples, drawn by hash, so a rerun fits the same forest; they are kept as a table of nodes. All rows are
scored, a batch of them at once, against that table, which is bounded by trees and sample whatever the data hold, and so is broadcast.

Defined cases: a null or NaN feature counts as 0; rows that are all alike score 0.5 (as does a single row) and none of them is an anomaly; an empty
table gives no node and no score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.browse import minute_features
from emberlog.session import written

#: Trees, rows of a tree, share of anomalies and seed.
TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.05, 42
#: Euler's constant, as the mean depth of a search in a random tree needs it.
EULER = 0.5772156649015329
#: Features of a minute, in the order of the nodes' feature numbers.
MINUTE = ("n", "warnings", "warning_ratio", "correlations", "hour_sin", "hour_cos")
NODES = "tree int, node long, depth int, n long, feature int, threshold double"
#: Scores are whole numbers of this part, so that ties are ties in every engine.
PLACES = 9


def usual_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def drawn(*parts: object) -> float:
    """A number in [0, 1) from the first 52 bits of an MD5 over the parts."""
    import hashlib

    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def values(columns: Sequence[str]) -> Column:
    return F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def samples(rows: DataFrame, key: str, columns: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """tree, x: the rows of each tree, those whose hash for the tree is smallest in a pool of at most trees * sample rows, itself drawn by hash."""
    pool = rows.select(F.col(key).cast("string").alias("key"), values(columns).alias("x"))
    pool = pool.orderBy(F.md5(F.concat(F.lit(f"{seed}:pool:"), "key")), "key").limit(trees * sample)
    dealt = pool.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "key", "x")
    # Spark keeps a tree's first rows of each task before the shuffle.
    first = Window.partitionBy("tree").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("tree").cast("string"), F.lit(":"), "key")), "key")
    return dealt.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).select("tree", "x")


def fit(rows: DataFrame, key: str, columns: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The forest's nodes, written: tree, node (1 is the root, 2k and 2k + 1 are the children of k), depth, n (rows of the sample), feature and threshold, null in leaves.

    A node with more than one row and depth left is cut at a drawn place between the least and the greatest value of a drawn feature
    that isn't constant in it; values up to the threshold go left.
    """
    most = math.ceil(math.log2(max(2, sample)))

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        tree, out = int(batch["tree"].iloc[0]), []
        waiting = [(1, 0, np.stack(batch["x"].to_numpy()))]
        while waiting:
            node, depth, x = waiting.pop()
            low, high = x.min(axis=0), x.max(axis=0)
            able = np.flatnonzero(low < high)
            if len(x) < 2 or depth >= most or not len(able):
                out.append((tree, node, depth, len(x), None, None))
                continue
            f = int(able[int(drawn(seed, tree, node, "feature") * len(able))])
            cut = float(low[f] + drawn(seed, tree, node, "threshold") * (high[f] - low[f]))
            out.append((tree, node, depth, len(x), f, cut))
            left = x[:, f] <= cut
            waiting += [(2 * node, depth + 1, x[left]), (2 * node + 1, depth + 1, x[~left])]
        made = pd.DataFrame(out, columns=["tree", "node", "depth", "n", "feature", "threshold"])
        return made.astype({"feature": "Int32", "threshold": "float64"})

    return written(samples(rows, key, columns, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODES))


def _arrays(nodes: DataFrame) -> tuple:
    """The forest by tree and number of node: feature (-1 in leaves), threshold, and how deep a row that ends in a node counts.

    At most trees * 2 * sample numbers each, as the nodes' table is no larger.
    """
    import numpy as np

    rows = nodes.select("tree", "node", "depth", "n", "feature", "threshold").toPandas()
    count, size = rows["tree"].nunique(), int(rows["node"].max()) + 1
    place = rows["tree"].rank(method="dense").astype(int).to_numpy() - 1, rows["node"].to_numpy()
    feature, threshold, depth = np.full((count, size), -1, "int64"), np.zeros((count, size)), np.full((count, size), np.nan)
    feature[place] = rows["feature"].fillna(-1).astype(int)
    threshold[place] = rows["threshold"].fillna(0.0)
    depth[place] = rows["depth"].to_numpy() + [usual_depth(int(n)) for n in rows["n"]]
    return feature, threshold, depth, usual_depth(int(rows.loc[rows["node"] == 1, "n"].max()))


def score(rows: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with score, from 0 to 1, higher where a row is parted sooner; to nine places.

    A batch of rows walks down a tree at once, level by level. (As an expression with lambdas over the nodes this took 40 times as long.)
    """
    if nodes.isEmpty():
        return rows.withColumn("score", F.lit(None).cast("double"))
    forest = rows.sparkSession.sparkContext.broadcast(_arrays(nodes))

    @F.pandas_udf("double")
    def walk(x: pd.Series) -> pd.Series:
        import numpy as np

        feature, threshold, depth, usual = forest.value
        if not len(x) or usual == 0:
            return pd.Series(np.full(len(x), 0.5))
        found, total, every = np.stack(x.to_numpy()), np.zeros(len(x)), np.arange(len(x))
        for f, cut, deep in zip(feature, threshold, depth):
            at = np.ones(len(x), "int64")
            while (inner := f[at] >= 0).any():
                right = found[every, np.maximum(f[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + right, at)
            total += deep[at]
        return pd.Series(2.0 ** (-total / len(feature) / usual))

    return rows.withColumn("score", F.round(walk(values(columns)), PLACES))


def quantile(scored: DataFrame, share: float, column: str = "score") -> float | None:
    """The exact quantile of numbers in [0, 1] with nine places, interpolated between its two neighbours.

    Such numbers are whole numbers below 2 ** 30, so a rank is found by their first 15 bits, then by the last 15: two counts of at
    most 32,768 groups, however many rows there are.
    """
    whole = scored.where(F.col(column).isNotNull()).select(F.round(F.col(column) * 10**PLACES).cast("long").alias("k"))
    high = sorted(whole.groupBy(F.shiftright("k", 15).alias("b")).count().collect())
    n = sum(r["count"] for r in high)
    if not n:
        return None
    at = share * (n - 1)
    first = math.floor(at)
    ranks, wanted, before = [first, min(first + 1, n - 1)], [], 0
    for r in high:
        wanted += [(r["b"], rank - before) for rank in ranks if before <= rank < before + r["count"]]
        before += r["count"]
    low = sorted(whole.where(F.shiftright("k", 15).isin(*{b for b, _ in wanted})).groupBy("k").count().collect())
    found = []
    for b, rank in wanted:
        for r in low:
            if r["k"] >> 15 == b:
                if rank < r["count"]:
                    found.append(r["k"] / 10**PLACES)
                    break
                rank -= r["count"]
    return found[0] + (found[1] - found[0]) * (at - first)


def flagged(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Adds anomaly: whether the score lies above the quantile that leaves the given share."""
    cut = quantile(scored, 1 - contamination)
    return scored.withColumn("anomaly", F.col("score") > F.lit(cut) if cut is not None else F.lit(False))


def minutes(events: DataFrame) -> DataFrame:
    """Features of each minute, with the share of warnings; written, as fitting and scoring read them."""
    features = minute_features(events)
    ratio = F.coalesce(F.col("warnings") / F.nullif("n", F.lit(0)), F.lit(0.0))
    return written(features.withColumn("warning_ratio", ratio))


def anomalous_minutes(events: DataFrame, contamination: float = CONTAMINATION, **options) -> DataFrame:
    """Minutes with score and anomaly, by a forest that is fitted on their own sample."""
    rows = minutes(events)
    return flagged(written(score(rows, fit(rows, "minute", MINUTE, **options), MINUTE)), contamination)
