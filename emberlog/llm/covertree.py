"""Operator 5: all pairs of vectors above a cosine, by dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), so the threshold is a radius and the triangle inequality
holds. The upper tree is built level by level over all vectors. A cell with more than BLOCK vectors (of WIDE components) gets up to FAN
children: its own center and those that a farthest-first traversal of a bounded sample of the cell adds, whose prefixes are
nested nets with halving radii. Every vector of the cell goes to the nearest of them, and a child's covering radius is
measured on all its vectors, not on the sample, so bounds are exact. Both sides of the pairs of cells descend together: a
pair goes on to its children's pairs only where centers and covering radii allow a link. A cell that fits a task, or
whose members must all link, rests.

Pairs whose furthest members must link are taken whole, from one row for each cell, however many vectors they
hold. For each pair that is left one task descends both cells' lower trees at once, built as far as
needed with halving radii: it prunes, takes whole, or compares leaves by a matrix product in double precision.

A task returns a count for each vector and the links of a forest, never pairs; equal vectors are one with a weight.
Where vectors have no structure at the threshold's scale no bound can prune, and exact results take all products of
BLOCK x BLOCK; that is so for any exact method. A cell that is still too large after DEPTH levels is dealt in parts by hash.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; of vectors
of different length the shorter ends in zeros, and a task's memory follows what its vectors hold, not the longest of them; repeated rows are vectors of their own; a null id counts as a link of
others and has none to name; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, own_columns
from emberlog.llm.components import components

#: Vectors of a cell on which its children's centers are fitted, about; those with the smallest hashes.
SAMPLE = 4096
#: Vectors of a cell that fits a task, children of a cell at most, levels of the upper tree at most.
BLOCK, FAN, DEPTH = 8192, 256, 8
#: Components that a vector may have to count as one; where vectors are longer, so many components count as one vector.
WIDE = 1024
ROOT = "r"
#: Rounding that bounds on distances are kept away from.
SLACK = 1e-7


def _named(rows: DataFrame) -> DataFrame:
    """vec_id, name (a digest, null where the vector links with nothing), unit (its components in double precision)."""

    def name(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names, raws = [], []
            for v in batch.column(1):
                raw = None
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("float64")
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()
                        raw = np.trim_zeros(x / np.sqrt(x @ x), "b").tobytes()
                names.append(hashlib.sha256(raw).digest()[:16] if raw else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, "binary"), pa.array(raws, "binary")], ["vec_id", "name", "unit"])

    return own_columns(rows, "vec_id", "embedding").mapInArrow(name, "vec_id long, name binary, unit binary")


def _matrix(raws: list[bytes]):
    """Rows with the inner products of the unit vectors: their first WIDE components, and the others in bands of doubling width.

    Of a band that few vectors reach only a triangular factor is kept, with as many columns as there are such vectors:
    rotations leave inner products alone. So one long vector doesn't widen the rows of all others by its length.
    """
    import numpy as np

    found = [np.frombuffer(raw) for raw in raws]
    longest = max(map(len, found))

    def band(rows: list[int], start: int, end: int):
        out = np.zeros((len(rows), end - start))
        for k, i in enumerate(rows):
            x = found[i][start:end]
            out[k, : len(x)] = x
        return out

    parts, at = [band(range(len(found)), 0, min(WIDE, longest))], WIDE
    while at < longest:
        rows = [i for i, x in enumerate(found) if len(x) > at]
        reached = band(rows, at, min(2 * at, longest))
        if 2 * len(rows) < reached.shape[1]:
            reached = np.linalg.qr(reached.T, mode="r").T
        part = np.zeros((len(found), reached.shape[1]))
        part[rows] = reached
        parts.append(part)
        at *= 2
    return np.hstack(parts) if len(parts) > 1 else parts[0]


def _size() -> Column:
    """How many vectors of WIDE components a group's units take, at least one for each."""
    return F.greatest(F.count("*"), F.ceil(F.sum(F.octet_length("unit")) / (8 * WIDE)))


def fit_centers(sample, most: int) -> list[int]:
    """The start of a farthest-first traversal, as places in the sample: each next one is furthest from those before."""
    import numpy as np

    chosen, far = [0], np.full(len(sample), np.inf)
    while True:
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[chosen[-1]])))
        if len(chosen) >= most or far.max() <= SLACK:
            return chosen
        chosen.append(int(far.argmax()))


class Node:
    """A node of the lower tree: members within `radius` of the center. Children have half the radius, but for one leaf of members that stand alone there."""

    LEAF, ALONE = 64, 48

    def __init__(self, x, members, center, radius: float, leaf: bool = False):
        self.x, self.members, self.center, self.radius = x, members, center, radius
        self.leaf = leaf or len(members) <= self.LEAF
        self._children: list[Node] | None = None

    @classmethod
    def root(cls, x) -> Node:
        import numpy as np

        return cls._around(x, np.arange(len(x)), False)

    @classmethod
    def _around(cls, x, members, leaf: bool) -> Node:
        import numpy as np

        center = x[members[0]]
        radius = float(np.sqrt(max(0.0, 2 - 2 * (x[members] @ center).min())))
        return cls(x, members, center, radius + SLACK, leaf)

    def children(self) -> list[Node]:
        import numpy as np

        if self._children is None:
            half, rest, alone, found = self.radius / 2, self.members, [], []
            run = 0
            while len(rest) and run < self.ALONE:
                near = self.x[rest] @ self.x[rest[0]] >= 1 - half * half / 2
                near[0] = True
                if near.sum() == 1:
                    alone.append(rest[0])
                    run += 1
                else:
                    found.append(Node._around(self.x, rest[near], False))
                    run = 0
                rest = rest[~near]
            lone = np.concatenate([np.array(alone, dtype=self.members.dtype), rest])
            if len(lone):
                found.append(Node._around(self.x, lone, True))
            self._children = found
        return self._children


class DualTraversal:
    """Counts and forest links between two sets of unit vectors, or within one."""

    def __init__(self, cosine: float, left, left_weights, right=None, right_weights=None):
        import numpy as np

        self.cosine, self.reach = cosine, float(np.sqrt(2 - 2 * cosine))
        self.same = right is None
        self.weights = [left_weights, left_weights if self.same else right_weights]
        self.n, self.left_x = len(left), left
        self.counts = [np.zeros(len(left), "int64"), np.zeros(0 if self.same else len(right), "int64")]
        self.links: list[tuple] = []
        a = Node.root(left)
        if self.same:
            self._within(a)
        else:
            self._between(a, Node.root(right))

    def _number(self, side: int, members):
        """Members in one numbering: the right side follows the left one."""
        return members + (self.n if side and not self.same else 0)

    def _add(self, side: int, members, counts) -> None:
        self.counts[0 if self.same else side][members] += counts

    def _within(self, a: Node) -> None:
        if 2 * a.radius <= self.reach - SLACK:
            w = self.weights[0][a.members]
            self._add(0, a.members, w.sum() - w)
            self._star(a.members)
        elif a.leaf:
            for at in range(0, len(a.members), 2048):
                part = a.members[at : at + 2048]
                self._products(part, part, True)
                if at:
                    self._products(a.members[:at], part, False)
        else:
            nodes = a.children()
            for i, x in enumerate(nodes):
                self._within(x)
                for y in nodes[i + 1 :]:
                    self._between(x, y)

    def _between(self, a: Node, b: Node) -> None:
        import numpy as np

        apart = float(np.sqrt(max(0.0, 2 - 2 * a.center @ b.center)))
        if apart > self.reach + a.radius + b.radius + SLACK:
            return
        if apart + a.radius + b.radius <= self.reach - SLACK:
            self._add(0, a.members, self.weights[1][b.members].sum())
            self._add(1, b.members, self.weights[0][a.members].sum())
            self._star(np.concatenate([self._number(0, a.members), self._number(1, b.members)]))
        elif a.leaf and b.leaf:
            for at in range(0, len(b.members), 2048):
                self._products(a.members, b.members[at : at + 2048], False, b.x)
        elif b.leaf or (not a.leaf and a.radius >= b.radius):
            for x in a.children():
                self._between(x, b)
        else:
            for y in b.children():
                self._between(a, y)

    def _star(self, numbers) -> None:
        import numpy as np

        if len(numbers) > 1:
            self.links.append((np.full(len(numbers) - 1, numbers[0]), numbers[1:]))

    def _products(self, p, q, triangle: bool, right=None) -> None:
        """Compares all members of p with those of q; with themselves, once, if triangle."""
        import numpy as np

        left = self.left_x
        right = left if right is None else right
        for at in range(0, len(p), 2048):
            rows = p[at : at + 2048]
            hit = left[rows] @ right[q].T >= self.cosine
            if triangle:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            r, c = hit.any(axis=1), hit.any(axis=0)
            hit, rows, cols = hit[np.ix_(r, c)], rows[r], q[c]
            self._add(0, rows, hit @ self.weights[1][cols])
            if not triangle:
                self._add(1, cols, hit.T @ self.weights[0][rows])
            # Labels that spread over the hits until they rest; then a link to each label's first member.
            a, b = self._number(0, rows), self._number(1, cols)
            label = b.copy()
            while True:
                of_rows = np.where(hit, label[None, :], np.iinfo("int64").max).min(axis=1)
                after = np.minimum(label, np.where(hit, of_rows[:, None], np.iinfo("int64").max).min(axis=0))
                if (after == label).all():
                    break
                label = after
            self.links += [(of_rows, a), (label, b)]


def _by_key(batches: Iterator, columns: int) -> Iterator:
    """The rows of a sorted stream, by their first columns."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
    return groupby(rows, key=lambda row: row[:columns])


def _compare(cosine: float):
    """A stream over the vectors of pairs of cells, sorted by pair: counts by vector, and links."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for (i, ci, j, cj), found in _by_key(batches, 4):
            rows = list(found)
            sides = [[r for r in rows if r[4] == s] for s in (0, 1)]
            itself = (i, ci) == (j, cj)
            if not itself and not all(sides):
                continue  # no vector fell into a part of the other cell
            both = _matrix([r[6] for s in sides for r in s])
            x = [both[: len(sides[0])], both[len(sides[0]) :]]
            w = [np.array([r[7] for r in s], "int64") for s in sides]
            pair = DualTraversal(cosine, x[0], w[0], *(() if itself else (x[1], w[1])))
            names = pa.array([r[5] for r in sides[0] + sides[1]], "binary")
            counts = np.concatenate(pair.counts)
            some = np.flatnonzero(counts)
            a = np.concatenate([some] + [u for u, _ in pair.links])
            b = np.concatenate([some] + [v for _, v in pair.links])
            n = np.concatenate([counts[some], np.zeros(len(a) - len(some), "int64")])
            keep = (n > 0) | (a != b)
            a, b, n = a[keep], pa.array(b[keep], mask=n[keep] > 0), n[keep]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(b), pa.array(n)], ["node", "other", "n"])

    return run


def _children(rows: DataFrame, cells: DataFrame, level: int) -> DataFrame:
    """parent, cell, unit, center (the unit's numbers): the cells below `cells`, from samples of their rows."""

    def fit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for (parent,), found in _by_key(batches, 1):
            sample = list(found)
            units = [sample[k][2] for k in fit_centers(_matrix([r[2] for r in sample]), sample[0][3])]
            columns = [pa.array([parent] * len(units)), pa.array([f"{parent}.{k}" for k in range(len(units))]), pa.array(units, "binary")]
            columns.append(pa.array([np.frombuffer(unit) for unit in units], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["parent", "cell", "unit", "center"])

    part = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(cells.select("cell", "n"), "cell").where(part * F.col("n") < SAMPLE)
    most = F.least(F.lit(FAN), F.greatest(F.lit(2 if level else 1), F.ceil(F.col("n") / BLOCK))).cast("int")
    own = cells.select("cell", F.lit(0).alias("side"), "unit", most.alias("most"))
    both = own.union(sample.select("cell", F.lit(1), "unit", F.lit(0)))
    dealt = both.repartition("cell").sortWithinPartitions("cell", "side", "unit")
    return materialize(dealt.mapInArrow(fit, "parent string, cell string, unit binary, center array<double>"))


def _assigned(rows: DataFrame, cells: DataFrame, children: DataFrame) -> DataFrame:
    """node, unit, weight, cell (the nearest child), far (the distance from its center). A cell's rows are dealt by hash; its children go to each part."""

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, found in _by_key(batches, 2):
            mixed = list(found)
            centers, members = [r for r in mixed if r[2] == 0], [r for r in mixed if r[2] == 1]
            if not members:
                continue
            both = _matrix([r[5] for r in centers + members])
            dots = both[len(centers) :] @ both[: len(centers)].T
            near = dots.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(near)), near]))
            columns = [pa.array([r[4] for r in members], "binary"), pa.array([r[5] for r in members], "binary"), pa.array([r[6] for r in members], "int64")]
            columns += [pa.array([centers[k][3] for k in near]), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "unit", "weight", "cell", "far"])

    parts = cells.select(F.col("cell").alias("parent"), F.ceil(F.col("n") / (4 * BLOCK)).cast("int").alias("parts"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    none = F.lit(None)
    centers = children.join(parts, "parent").select(
        "parent", each, F.lit(0).alias("side"), "cell", none.cast("binary").alias("node"), "unit", none.cast("long").alias("weight")
    )
    dealt = rows.withColumnRenamed("cell", "parent").join(parts, "parent")
    members = dealt.select("parent", F.pmod(F.xxhash64("node"), "parts").cast("int"), F.lit(1), none.cast("string"), "node", "unit", "weight")
    both = centers.union(members).repartition("parent", "part").sortWithinPartitions("parent", "part", "side", "cell", "node")
    return materialize(both.mapInArrow(assign, "node binary, unit binary, weight long, cell string, far double"))


def _descended(pairs: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """i, j, whole: pairs of the cells below each pair that may hold a link, and whether all their members must link. `cells` names a resting cell as its own parent."""

    def side(name: str, parent: str) -> DataFrame:
        return cells.select(F.col("parent").alias(parent), F.struct("cell", "center", "radius").alias(name))

    def dot(a: Column, b: Column) -> Column:
        shared = F.least(F.size(a), F.size(b))
        a, b = [F.when(F.size(x) == shared, x).otherwise(F.slice(x, 1, shared)) for x in (a, b)]
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    a, b = F.col("a"), F.col("b")
    met = pairs.select("i", "j").join(side("a", "i"), "i").join(side("b", "j"), "j").where((F.col("i") != F.col("j")) | (a["cell"] <= b["cell"]))
    same = a["cell"] == b["cell"]
    apart = F.when(same, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a["center"], b["center"]))))
    measured = met.select(F.least(a["cell"], b["cell"]).alias("i"), F.greatest(a["cell"], b["cell"]).alias("j"), same.alias("same"), apart.alias("apart"), (a["radius"] + b["radius"]).alias("radii"))
    near = measured.where(F.col("same") | (F.col("apart") <= reach + F.col("radii") + 4 * SLACK))
    return materialize(near.select("i", "j", (F.col("apart") + F.col("radii") <= reach - 4 * SLACK).alias("whole")))


def _upper_tree(nodes: DataFrame, n: int, first: bytes, reach: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors (node, unit, weight, cell), the resting cells (cell, size n, parts, total weight, first member) and their pairs (i, j, whole).

    nodes names the root, ROOT, as the cell of each of its vectors, whose size is n; first is the unit of one of them.
    """
    spark, rows = nodes.sparkSession, nodes
    cells = spark.createDataFrame([(ROOT, bytearray(first), n)], "cell string, unit binary, n long")
    pairs = spark.createDataFrame([(ROOT, ROOT)], "i string, j string")
    placed, resting = [], []
    for level in range(DEPTH):
        children = _children(rows, cells, level)
        below = _assigned(rows, cells, children)
        # A cell too large for a task is cut into parts, but not into more than it has vectors.
        parts = F.least(F.ceil(_size() / BLOCK), F.count("*")).cast("int").alias("parts")
        stats = below.groupBy("cell").agg(_size().alias("n"), parts, F.sum("weight").alias("total"), F.max("far").alias("radius"), F.min("node").alias("first"))
        below_cells = materialize(children.join(stats, "cell"))
        rests = F.lit(level == DEPTH - 1) | (F.col("n") <= BLOCK) | (2 * F.col("radius") <= reach - 4 * SLACK)
        known = below_cells.select("parent", "cell", "center", "radius")
        for earlier in resting:
            known = known.union(earlier.select("cell", "cell", "center", "radius"))
        pairs = _descended(pairs, known, reach)
        resting.append(below_cells.where(rests))
        placed.append(below.join(resting[-1].select("cell"), "cell", "left_semi").select("node", "unit", "weight", "cell"))
        cells = below_cells.where(~rests).select("cell", "unit", "n")
        if cells.isEmpty():
            break
        rows = below.join(cells.select("cell"), "cell", "left_semi").select("node", "unit", "weight", "cell")
    vectors, found = placed[0], resting[0].select("cell", "n", "parts", "total", "first")
    for more, others in zip(placed[1:], resting[1:]):
        vectors, found = vectors.union(more), found.union(others.select("cell", "n", "parts", "total", "first"))
    return vectors, found, pairs


def _both_ways(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, parts, other, other_parts, total and first of the other: each pair from both its sides, a cell with itself once."""
    ways = pairs.select(F.col("i").alias("cell"), F.col("j").alias("other")).union(pairs.where("i != j").select("j", "i"))
    other = cells.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts"), "total", "first")
    return ways.join(cells.select("cell", "parts"), "cell").join(other, "other")


def _taken_whole(vectors: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, other, n of the pairs that are whole: each member counts all of the other cell and links with one of it; so do the cells' first members."""
    ways = _both_ways(pairs.where("whole"), cells)
    gains = ways.groupBy("cell").agg(F.sum("total").alias("gain"), F.max(F.col("cell") == F.col("other")).alias("itself"), F.min("first").alias("hub"))
    own = F.when(F.col("itself"), F.col("weight")).otherwise(0)
    members = vectors.join(gains, "cell").select("node", F.col("hub").alias("other"), (F.col("gain") - own).alias("n"))
    firsts = ways.where("cell != other").join(cells.select("cell", F.col("first").alias("node")), "cell")
    return members.union(firsts.select("node", F.col("first").alias("other"), F.lit(0).cast("long").alias("n")))


def _compared(vectors: DataFrame, cells: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """node, other, n of the pairs that aren't whole, each in a task of its own; cells of more than BLOCK vectors in parts."""
    ways = _both_ways(pairs.where("NOT whole"), cells)
    meets = ways.select("cell", "other", "parts", "other_parts")
    part = vectors.join(meets, "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    each = part.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    own, other = F.struct(F.col("cell").alias("c"), F.col("part").alias("p")), F.struct(F.col("other").alias("c"), F.col("other_part").alias("p"))
    low, high = F.least(own, other), F.greatest(own, other)
    side = F.when(own <= other, 0).otherwise(1).alias("side")
    keyed = each.select(low["c"].alias("i"), low["p"].alias("ci"), high["c"].alias("j"), high["p"].alias("cj"), side, "node", "unit", "weight")
    pair = ["i", "ci", "j", "cj"]
    dealt = keyed.repartition(*pair).sortWithinPartitions(*pair, "side", "node")
    return dealt.mapInArrow(_compare(cosine), "node binary, other binary, n long")


def link_vectors(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    named = materialize(_named(rows))
    # Equal vectors are one node, called by their digest: ids may be null or repeat.
    known = named.where("name IS NOT NULL").withColumnRenamed("name", "node")
    grouped = known.groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    # The root is written with them: joins on it are by a column then, not by a constant that would make them products.
    nodes = materialize(grouped.withColumn("cell", F.lit(ROOT)))
    size = nodes.agg(_size().alias("n"), F.min_by("unit", "node").alias("unit")).first()
    if not size["n"]:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    vectors, cells, pairs = _upper_tree(nodes.select("node", "unit", "weight", "cell"), size["n"], size["unit"], (2 - 2 * cosine) ** 0.5)
    found = materialize(_compared(vectors, cells, pairs, cosine).union(_taken_whole(vectors, cells, pairs)))
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    grouped = nodes.drop("cell").join(labels, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"))
    total = F.coalesce("n", F.lit(0)) + F.col("weight") - 1
    linked = grouped.join(least, "group").join(counts, "node", "left").select(F.col("node").alias("name"), "component_id", total.alias("n_links"))
    joined = named.select("vec_id", "name").join(linked, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
