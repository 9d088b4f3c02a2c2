"""The isolation forest against a walk by hand, and its exact cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import isolation

COLUMNS = ("a", "b", "c")


def features(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(f"k{k}", rng.gauss(0, 1), float(rng.randrange(3)), 1.0) for k in range(n)] + [("far", 40.0, 2.0, 1.0), ("null", None, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "key string, a double, b double, c double")


def by_hand(rows, nodes):
    """Scores from the table of nodes, row by row."""
    tree = {(r["tree"], r["node"]): r for r in nodes}
    trees = sorted({t for t, _ in tree})
    usual = isolation.usual_depth(max(r["n"] for r in nodes if r["node"] == 1))
    out = {}
    for r in rows:
        x = [0.0 if r[c] is None or r[c] != r[c] else r[c] for c in COLUMNS]
        total = 0.0
        for t in trees:
            at = 1
            while (node := tree[t, at])["feature"] is not None:
                at = 2 * at + (x[node["feature"]] > node["threshold"])
            total += node["depth"] + isolation.usual_depth(node["n"])
        out[r["key"]] = 2 ** (-total / len(trees) / usual)
    return out


@pytest.mark.parametrize("n,trees,sample", [(300, 20, 64), (30, 10, 256), (3000, 5, 16)])
def test_scores_follow_the_nodes(spark, n, trees, sample):
    df = features(spark, n)
    nodes = isolation.fit(df.repartition(3), "key", COLUMNS, trees, sample)
    found = nodes.collect()
    roots = [r for r in found if r["node"] == 1]
    assert len(roots) == trees and all(r["n"] == min(sample, n + 2) for r in roots)
    assert all(r["feature"] != 2 for r in found)  # a constant feature cuts nothing
    by_place = {(r["tree"], r["node"]): r for r in found}
    for (t, k), r in by_place.items():
        if r["feature"] is not None:
            left, right = by_place[t, 2 * k], by_place[t, 2 * k + 1]
            assert left["n"] + right["n"] == r["n"] and left["n"] and right["n"] and left["depth"] == r["depth"] + 1
    got = {r["key"]: r["score"] for r in isolation.score(df, nodes, COLUMNS).collect()}
    want = by_hand(df.collect(), found)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if sample >= 64:
        assert max(got, key=got.get) == "far"
    again = isolation.fit(df.orderBy(F.desc("key")), "key", COLUMNS, trees, sample).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.951, 1.0])
def test_quantile_is_exact(spark, share):
    rng = random.Random(3)
    values = [round(rng.random() ** 3, 9) for _ in range(400)] + [0.25] * 90 + [0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "score double")
    assert isolation.quantile(df, share) == pytest.approx(float(np.quantile(values, share)), abs=1e-12)
    assert isolation.quantile(df.where("score > 2"), share) is None


def test_rows_that_are_alike_or_missing(spark):
    one = spark.createDataFrame([("a", 1.0, 1.0, 1.0)] * 3, "key string, a double, b double, c double")
    for df in (one, one.limit(1)):
        done = isolation.flagged(isolation.score(df, isolation.fit(df, "key", COLUMNS, 3, 8), COLUMNS)).collect()
        assert {(r["score"], r["anomaly"]) for r in done} == {(0.5, False)}
    none = one.limit(0)
    nodes = isolation.fit(none, "key", COLUMNS, 3, 8)
    assert nodes.count() == 0 and isolation.flagged(isolation.score(none, nodes, COLUMNS)).count() == 0
