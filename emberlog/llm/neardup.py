"""Operator 4: near-duplicate documents, by an LSH forest with links confirmed on full sets.

Texts with equal sets of shingles are one class, named by its smallest id and a digest of the set. Each class has 32
sorted signature orders (the trees): the MinHash signature read from another place in each. Classes that share a longest
common prefix of at least DEPTH values in an order are candidates: at a similarity of 0.8 two classes miss each other in
all orders with a probability of 5e-8.

The depth adapts to the region: a prefix that more classes share than one task may compare is cut into stretches by the
values that follow, so those that share longer prefixes are compared first. Each stretch names the most typical member
of every group it found; these heads meet again, in stretches if need be, so that a region that is one group becomes one
component in a few rounds, whatever its size. Only stretches that hold different components afterwards are compared
in pairs, so that no link at the shallow depth is lost.

Orders are taken in waves. What earlier waves have connected isn't compared again: a prefix's classes are looked at
only while they belong to different components. Every comparison is of full sets; pairs are never emitted, only links
between components. So copies by the thousand cost a row each, not a row for each pair.

Defined cases: a text without words links with nothing; classes of null ids alone link with nothing either, but a null
id takes part as a copy (its class has the id of its others); rows that repeat an id are judged by their own text;
an empty table gives no rows. Other columns of the input are ignored by link_documents() and kept by first_of_group().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, own_columns
from emberlog.llm.components import components
from emberlog.llm.shingles import Shingler, mix

#: Orders by wave; the first ones connect most groups, so that later ones look at little.
WAVES = (range(0, 2), range(2, 8), range(8, 32))
#: Values of a prefix (its depth) and their number in a signature.
DEPTH, TREES = 4, 32
#: What a task compares at once, in classes and in bytes of their sets.
STRETCH, STRETCH_BYTES = 4096, 24 << 20
#: Bits of the candidates' filter for each candidate, and at most. Beyond that more documents pass, to no effect but work.
FILTER_RATE, MOST_BITS = 16, 1 << 26
#: Bytes kept of a shingle's hash in the compared sets.
WIDTH = 6


def _digests(s) -> tuple[int, int]:
    """Two independent 64-bit digests of a set of hashes, signed."""
    import numpy as np

    one, two = mix(s + np.uint64(11)).sum(dtype="uint64"), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    return int(np.int64(one.astype("int64"))), int(np.int64(two.astype("int64")))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, d1, d2 (digests of the set), keys: each order's prefix of DEPTH 16-bit values as one number."""

    def sketch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingler = Shingler(k)
        factors = np.random.default_rng(7).integers(0, 1 << 63, DEPTH * TREES, dtype="uint64") * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sizes, ones, twos, keys = [], [], [], []
            for s in shingler.sets(batch.column(1)):
                low = np.full(len(factors), 2**64 - 1, "uint64")
                for at in range(0, len(s), 256):
                    np.minimum(low, np.multiply.outer(s[at : at + 256], factors).min(axis=0), out=low)
                one, two = _digests(s)
                sizes.append(len(s))
                ones.append(one)
                twos.append(two)
                # A minimum's high bits say little, the more so the larger the set; mixed, all bits count.
                keys.append((mix(low) & np.uint64(0xFFFF)).astype("uint16").view("int64"))
            columns = [batch.column(0), batch.column(2), pa.array(sizes, "int64"), pa.array(ones, "int64"), pa.array(twos, "int64"), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_shingles", "d1", "d2", "keys"])

    rows = own_columns(docs, "doc_id", "text").select("doc_id", "text", _text_hash().alias("th"))
    return rows.mapInArrow(sketch, "doc_id long, th long, n_shingles long, d1 long, d2 long, keys array<long>")


def _bitmap(ids: DataFrame, n: int) -> tuple[int, bytes]:
    """A filter over a column id of n rows, FILTER_RATE bits for each up to MOST_BITS, which bounds what reaches the driver."""
    import numpy as np

    bits = min(MOST_BITS, 1 << max(16, (n * FILTER_RATE - 1).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(bit / 64).alias("word"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(id), 64) AS INT))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, "int64")
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits, out.tobytes()


def candidate_sets(docs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """id, d1, shingles for the candidates (id, d1): sets as WIDTH-byte numbers, sorted.

    A filter keeps most other documents from being shingled again; what passes it by chance goes in the join.
    """
    spark = docs.sparkSession
    wanted = materialize(candidates.select("id", "d1").distinct())
    bits, filled = _bitmap(wanted.select("id"), wanted.count())
    shared = spark.sparkContext.broadcast(filled)

    def fetch(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingler, words = Shingler(k), np.frombuffer(shared.value, "int64")
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (words[h % bits // 64] >> (h % 64)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            ones, sets = [], []
            for s in shingler.sets(batch.column(1)):
                ones.append(_digests(s)[0])
                sets.append(np.unique(s >> np.uint64(64 - 8 * WIDTH)).view("uint8").reshape(-1, 8)[:, :WIDTH].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ones, "int64"), pa.array(sets, "binary")], ["id", "d1", "shingles"])

    rows = own_columns(docs, "doc_id", "text").where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = rows.mapInArrow(fetch, "id long, d1 long, shingles binary")
    # Rows that repeat meet in the map-side part of the aggregate; both sides then lie by the same keys.
    return materialize(sets.groupBy("id", "d1").agg(F.first("shingles").alias("shingles")).join(wanted, ["id", "d1"], "left_semi"))


def _links(groups: list, sets: list, parts: list | None, percent: int) -> tuple[list[int], list[int]]:
    """For each member the number of its group after all links are made, and the most typical member of each group of several.

    groups: what is known to belong together. Exact on the full sets, for the groups. The most typical members come
    first, so hubs connect a group early; who belongs to the same group by then isn't compared. parts: compare only
    members of different parts.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    offsets = np.r_[0, np.cumsum(sizes)]
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = offsets[:-1]
    typical = np.add.reduceat(count[code], starts) / sizes
    number = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    group = np.array([number[g] for g in groups])
    part = None if parts is None else np.array(parts)
    mark, left = np.zeros(len(count), bool), np.ones(len(sizes), bool)
    order = np.argsort(-typical, kind="stable")
    for p in order:
        left[p] = False
        other = left & (group != group[p]) & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))
        if part is not None:
            other &= part != part[p]
        if not other.any():
            if (group == group[0]).all():
                break
            continue
        own = code[offsets[p] : offsets[p + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[code], starts, dtype="int64")
        mark[own] = False
        for x in np.flatnonzero(other & (100 * common >= percent * (sizes + sizes[p] - common))):
            if group[x] != group[p]:
                group[group == group[x]] = group[p]
    several, heads = np.bincount(group) > 1, {}
    for p in order:
        if several[group[p]]:
            heads.setdefault(group[p], int(p))
    return group.tolist(), list(heads.values())


FOUND = "a struct<id:long,d1:long>, b struct<id:long,d1:long>, t int, k long, next long, n long"


def _compare(percent: int, across: bool):
    """A stream over rows sorted by cell (t, k, lo, hi): links between components, and heads of cells that are part of a region."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        node_type = pa.struct([("id", pa.int64()), ("d1", pa.int64())])
        types = {"a": node_type, "b": node_type, "t": pa.int32(), "k": pa.int64(), "next": pa.int64(), "n": pa.int64()}
        key, rows, out = None, [], []

        def close() -> None:
            groups = [r["component"] for r in rows]
            known = [(g["id"], g["d1"]) for g in groups]
            region = bool(rows) and not across and rows[0]["parts"] > 1
            if len(set(known)) < 2 and not region:
                return
            ends, heads = _links(known, [r["set"] for r in rows], [r["stretch"] for r in rows] if across else None, percent)
            members: dict[int, set] = {}
            for g, e in zip(known, ends):
                members.setdefault(e, set()).add(g)
            for found in members.values():
                least = min(found)
                out.extend((least, g, None, None, None, None) for g in found if g != least)
            if region:
                out.extend(((rows[p]["node"]["id"], rows[p]["node"]["d1"]), None, rows[p]["t"], rows[p]["k"], rows[p]["next"], rows[p]["n"]) for p in heads)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            cols[:2] = [[x and {"id": x[0], "d1": x[1]} for x in c] for c in cols[:2]]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types.values())], list(types))
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    cell = (r["t"], r["k"], r["lo"], r["hi"])
                    if cell != key:
                        close()
                        key, rows = cell, []
                    raw = r.pop("shingles")
                    wide = np.zeros((len(raw) // WIDTH, 8), "uint8")
                    wide[:, :WIDTH] = np.frombuffer(raw, "uint8").reshape(-1, WIDTH)
                    r["set"] = wide.view("uint64").ravel()
                    rows.append(r)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def _pieces(most: int) -> Column:
    """In how many parts rows of one key go, by their number and the bytes of their sets. For an aggregate."""
    return F.ceil(F.greatest(F.count("*") / most, F.sum("n") * WIDTH / STRETCH_BYTES)).alias("parts")


def _dealt(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, n, t, k, next) whose prefix (t, k) is shared, with parts and stretch; and those of regions alone.

    Depth adapts here: where a prefix holds more than a task may compare, its region is cut by what follows in the order,
    so those that share longer prefixes stay together; only what shares all of it beyond a task's measure is cut by hash.
    """
    rows = rows.select("node", "n", "t", "k", "next")
    shared = rows.groupBy("t", "k").agg(F.count("*").alias("members"), _pieces(most)).where("members > 1").drop("members")
    rows = materialize(rows.join(shared, ["t", "k"]).withColumn("stretch", F.lit(0).cast("long")))
    dense = rows.where("parts > 1")
    if dense.isEmpty():
        return rows, dense
    alike = dense.groupBy("t", "k", "next").agg(_pieces(most).alias("own"))
    bucket = F.shiftright(F.shiftrightunsigned("next", 32) * F.col("parts"), 32)
    cut = bucket * (1 << 24) + F.pmod(F.xxhash64("node"), "own")
    dense = materialize(dense.join(alike, ["t", "k", "next"]).withColumn("stretch", cut).select(*rows.columns))
    return rows.where("parts = 1").unionByName(dense), dense


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _contract(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """The labels after links (a, b) between components."""
    links = found.where("b IS NOT NULL").select("a", "b")
    if links.isEmpty():
        return labels
    later = components(links)
    if labels is None:
        return later
    step = later.toDF("component", "into")
    moved = labels.join(step, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return materialize(moved.unionByName(later.join(labels, "node", "left_anti")))


def _live(named: DataFrame, cell: list[str], sets: DataFrame, regions: bool) -> DataFrame:
    """The rows, with their sets, of cells that hold different components; those of regions in any case."""
    differ = named.groupBy(*cell).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select(*cell)
    live = named.join(differ, cell, "left_semi") if not regions else named.join(differ.withColumn("open", F.lit(True)), cell, "left").where("open OR parts > 1").drop("open")
    joined = live.withColumn("id", F.col("node.id")).withColumn("d1", F.col("node.d1")).join(sets, ["id", "d1"])
    return joined.select("t", "k", "lo", "hi", "node", "component", "next", "n", "parts", "stretch", "shingles")


def _wave(rows: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int, most: int) -> DataFrame | None:
    """Compares the classes of each shared prefix that belong to different components; the labels afterwards."""
    cell = ["t", "k", "lo", "hi"]
    regions = None
    while rows is not None:
        rows, dense = _dealt(rows, most)
        some = not dense.isEmpty()
        regions = dense if regions is None and some else regions
        named = _labelled(rows, labels).withColumn("lo", F.col("stretch")).withColumn("hi", F.col("stretch"))
        ordered = _live(named, cell, sets, some).repartition(*cell).sortWithinPartitions(*cell, "node")
        found = materialize(ordered.mapInArrow(_compare(percent, False), FOUND))
        labels = _contract(labels, found)
        # The heads of a region's stretches meet each other next: what is one group is one component after few rounds.
        rows = found.where("b IS NULL").withColumnRenamed("a", "node") if some else None
    if regions is None:
        return labels
    # What a region still holds of different components is compared whole: each pair of stretches is a cell.
    named = materialize(_labelled(regions, labels))
    stretches = named.groupBy("t", "k", "stretch").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = stretches.groupBy("t", "k").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("t", "k")
    ends = materialize(stretches.join(mixed, ["t", "k"], "left_semi"))
    left, right = ends.toDF("t", "k", "lo", "x", "y"), ends.toDF("t", "k", "hi", "u", "v")
    pairs = left.join(right, ["t", "k"]).where("lo < hi AND NOT (x = y AND u = v AND x = u)").select(*cell)
    sides = pairs.withColumn("stretch", F.explode(F.array("lo", "hi")))
    ordered = _live(named.join(sides, ["t", "k", "stretch"]), cell, sets, False).repartition(*cell).sortWithinPartitions(*cell, "stretch", "node")
    return _contract(labels, materialize(ordered.mapInArrow(_compare(percent, True), FOUND)))


def near_links(docs: DataFrame, classes: DataFrame, k: int, percent: int, most: int = STRETCH) -> DataFrame | None:
    """node (id and digest of a class), component (its smallest node) for the classes that link with another."""
    keys = F.col("keys")
    order = F.transform(keys, lambda x, i: F.struct(x.alias("k"), F.coalesce(F.get(keys, i + 1), F.get(keys, F.lit(0))).alias("next")))
    node = F.struct(F.col("id"), F.col("d1")).alias("node")
    rows = classes.where("id IS NOT NULL").select(node, F.col("n_shingles").alias("n"), F.posexplode(order).alias("t", "x")).select("node", "n", "t", "x.k", "x.next")
    shared = rows.groupBy("t", "k").agg(F.count("*").alias("members")).where("members > 1").select("t", "k")
    rows = materialize(rows.join(shared, ["t", "k"], "left_semi"))
    sets = candidate_sets(docs, rows.select("node.id", "node.d1"), k)
    labels = None
    for wave in WAVES:
        labels = _wave(rows.where(F.col("t").isin(list(wave))), sets, labels, percent, most)
    return labels


def _classified(docs: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, class_id (null where alone: no words), component for every row."""
    sketched = materialize(sketches(docs, k))
    classes = materialize(sketched.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    labels = near_links(docs, classes, k, percent, most)
    node = F.struct("id", "d1")
    named = classes.select("d1", "d2", "n_shingles", node.alias("node"))
    named = named.withColumn("component", F.col("node")) if labels is None else _labelled(named, labels)
    # Where a text has no words the row stays alone, and the join finds nothing for it.
    return sketched.select("doc_id", "th", "n_shingles", "d1", "d2").join(named.drop("node"), ["d1", "d2", "n_shingles"], "left").drop("d1", "d2")


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: k words a shingle, similarity of percent/100 or more."""
    component = F.coalesce("component.id", "doc_id")
    found = _classified(docs, k, percent, stretch)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_group(docs: DataFrame, k: int = 5, percent: int = 80, stretch: int = STRETCH) -> DataFrame:
    """The rows of docs with one document of each group, that with the smallest id, in the columns of docs.

    Of rows of a group that repeat its smallest id one stays, with the smallest hash of its text; of rows that repeat
    both, any one. Null ids come last. Rows without words all stay.
    """
    found = _classified(docs, k, percent, stretch).where("component IS NOT NULL").groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    found = materialize(found)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    judged = found.join(first, "component").select("doc_id", "th", "n", (place == F.col("first")).alias("stays"))
    # One row for each (id, text hash) that goes or repeats; most documents have none.
    special = materialize(judged.where("n > 1 OR NOT stays").select(F.struct("doc_id", "th").alias("key"), "stays"))
    own = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", _text_hash().alias("th")).alias("key"))
    rows = docs.select(own.alias("x")).select("x.row", "x.key")
    plain = rows.join(special, "key", "left_anti").select("row.*")
    once = rows.join(special.where("stays").select("key"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return plain.unionByName(once.select("row.*"))
