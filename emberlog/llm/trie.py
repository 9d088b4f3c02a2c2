"""Operator 12: the trie of conversation prefixes, by preorder intervals.

A node is a distinct sequence of first turns. Its key is its depth and two XORs over hashes of (position, turn), which are prefix
sums: each conversation is cut into blocks of turns, and one row for each block carries what came before. Conversations are
ranked lexicographically, so a node's members are an interval of ranks. A rank needs only the turns at which a
conversation leaves others, as between them its members stay the same: one entry for each node with fewer members than its parent. The
keys of all conversations together hold no more entries than there are turns, and the longest at most the root of twice their number.

In preorder nodes stand by the first rank of their members, then by depth, and a subtree ends before the first node of the rank after
its last member. Leaves and savings of a subtree are thus differences of prefix sums over the preorder, which range partitions
compute with one carried row each. Hot keys (a first turn that a third of all conversations share, a conversation with a third of all turns,
a parent of most nodes) are looked up in bounded broadcast tables (common.look_up), and counted before they are shuffled.

Defined cases: a null role or text is empty; turns stand in order, nulls first, equal ones by digest; a turn that repeats is a turn of
its own; rows without a conversation's id belong to none and are left out; a conversation may have no turn and is a member of the root then; an
empty table has no node, not even a root; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import look_up, materialize, own_columns, word_array
from emberlog.llm.ranks import numbered

#: Turns of a conversation whose prefixes one task computes.
BLOCK = 4096
#: Members of a node whose ids one row of its list holds.
LISTED = 1024

#: What names a node.
KEY = ["depth", "a", "b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turns (of the conversation), digest, words: a row for each turn, in order, without its text."""
    rows = own_columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = rows.select("conv_id", "turn", digest.alias("digest"), F.size(word_array(text)).cast("long").alias("words"))
    return materialize(numbered(turns, ["conv_id"], ["turn", "digest"]).select("conv_id", "place", F.col("n").alias("turns"), "digest", "words"))


def members_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns: one row for each conversation."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"))


def own_head(key: str = "conv_id", most: int = 4) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % most


def graft(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their base in place of their own: turns and members, as numbered_turns() and members_of() give them.

    The base of c is c - c % every, and c takes its first h turns, or all if it has fewer, then its own after its first h; h is the CRC
    of the decimal c modulo `most`.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = materialize(turns.where((F.col("conv_id") == base) & (F.col("place") < most - 1)).select(F.col("conv_id").alias("base"), "place", "digest", "words"))
    there = heads.groupBy("base").agg(F.count("*").alias("there"))
    plain = members_of(turns).select("*", base.alias("base"), own_head(most=most).alias("h"))
    taken = F.least(F.coalesce("there", F.lit(0)), "h")
    members = materialize(plain.join(there, "base", "left").withColumn("taken", taken))
    given = members.join(heads, "base").where("place < h").select("conv_id", "place", "digest", "words")
    # Only those whose base has too few turns move; a row for each, looked up so that a long conversation stays dealt.
    moved = materialize(members.where("taken < h").select("conv_id", (F.col("taken") - F.col("h")).alias("shift"), F.col("turns").alias("n")))
    rest = look_up(turns.where(F.col("place") >= own_head(most=most)).select("conv_id", "place", "digest", "words"), moved, ["conv_id"])
    rest = rest.select("conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "digest", "words")
    sizes = members.select("conv_id", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("turns"))
    return given.union(rest), materialize(sizes)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, words, and the keys of the prefix that a turn ends (depth, a, b) and of the one before it (ua, ub)."""
    rows = turns.withColumn("depth", F.col("place") + 1)
    rows = rows.select("conv_id", "depth", "words", F.expr(f"place div {BLOCK}").alias("block"), F.xxhash64("depth", "digest").alias("x"), F.xxhash64("digest", "depth", F.lit(1)).alias("y"))
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", F.bit_xor("tx").over(before).alias("cx"), F.bit_xor("ty").over(before).alias("cy"))
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"px": F.bit_xor("x").over(running), "py": F.bit_xor("y").over(running)})
    found = rows.join(carried, ["conv_id", "block"])
    a, b = (F.col(p).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for p, c in (("px", "cx"), ("py", "cy")))
    found = found.withColumns({"a": a, "b": b})
    return materialize(found.select("conv_id", *KEY, F.col("a").bitwiseXOR(F.col("x")).alias("ua"), F.col("b").bitwiseXOR(F.col("y")).alias("ub"), "words"))


def _nodes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct nodes with the root: members, smallest member, words, children, and their parent's key, members and smallest member."""
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.first("ua").alias("ua"), F.first("ub").alias("ub"))
    none = F.lit(None).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    found = materialize(found.union(root.select(zero, zero, zero, "n_convs", "conv_id", zero, none, none)))
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count("*").alias("n_children"))
    found = materialize(found.join(children, KEY, "left").fillna(0, ["n_children"]))
    parents = materialize(found.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"), F.col("n_children").alias("n")))
    return materialize(look_up(found, parents, ["depth", "ua", "ub"]))


def _ranks(rows: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, turns, rank: the place of each conversation in lexicographic order, equal ones by id."""
    leaving = materialize(nodes.where("n_convs < parent_convs").select(*KEY, F.col("n_convs").alias("n")))
    steps = look_up(rows.select("conv_id", *KEY), leaving, KEY).where("there")
    keys = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("key"))
    empty = F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint>>")
    keyed = members.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", empty))
    return materialize(numbered(keyed, [], ["key", "conv_id"]).select("conv_id", "turns", F.col("place").alias("rank")))


def _end_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256 from KEY, rank, conv_id of each conversation at the node where it ends.

    Ids are listed in blocks of ranks first, so that the task of a node in which very many end reads a row for each block, not each id.
    """
    listed = ends.groupBy(*KEY, F.expr(f"rank div {LISTED}").alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    lines = listed.select(*KEY, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        key, h = None, None

        def row(keys, digests):
            cols = list(zip(*keys)) if keys else [()] * 3
            return pa.RecordBatch.from_arrays([*[pa.array(c, "int64") for c in cols], pa.array(digests, "string")], [*KEY, "ends_sha256"])

        for batch in batches:
            keys, digests = [], []
            for at, ids in zip(zip(*[batch.column(k).to_pylist() for k in range(3)]), batch.column(4).to_pylist()):
                if at != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(h.hexdigest())
                    key, h = at, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield row(keys, digests)
        if key is not None:
            yield row([key], [h.hexdigest()])

    return lines.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node of the trie over numbered turns.

    position and end (preorder places of the node and of the last node of its subtree), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and first_rank: its members have the n_convs ranks from there on.
    """
    rows = prefixes(turns)
    nodes = _nodes(rows, members)
    ranks = _ranks(rows, members, nodes)
    by_conv = materialize(ranks.select("conv_id", "rank", F.col("turns").alias("n")))
    ranked = materialize(look_up(rows.select("conv_id", *KEY), by_conv, ["conv_id"]))
    zero = F.lit(0).cast("long")
    firsts = ranked.groupBy(*KEY).agg(F.min("rank").alias("first_rank")).union(nodes.where("depth = 0").select(*KEY, zero))
    last = ranked.join(ranks.where("turns > 0").select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"]).select(*KEY, "rank", "conv_id")
    ends = last.union(ranks.where("turns = 0").select(zero, zero, zero, "rank", "conv_id"))
    own = nodes.join(firsts, KEY).withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"), "after": F.col("first_rank") + F.col("n_convs")})
    placed = materialize(numbered(own, [], ["first_rank", "depth"], ["leaf", "saved"]).withColumnRenamed("place", "position"))
    # Where the nodes of a rank begin: the end of all subtrees whose last member has the rank before. Past the last rank are the totals.
    starts = placed.groupBy(F.col("first_rank").alias("after")).agg(F.min("position").alias("stop"), F.min("leaf_before").alias("leaf_stop"), F.min("saved_before").alias("saved_stop"))
    total = placed.agg(F.max(F.when(F.col("depth") == 0, F.col("n_convs"))).alias("after"), F.count("*").alias("stop"), F.sum("leaf").alias("leaf_stop"), F.sum("saved").alias("saved_stop"))
    asked = placed.groupBy("after").agg(F.count("*").alias("n"))
    bounds = materialize(asked.join(starts.union(total.where("after IS NOT NULL")), "after"))
    done = look_up(placed.drop("n"), bounds, ["after"])
    done = done.join(_end_digests(ends), KEY, "left")
    return done.select(
        "position", (F.col("stop") - 1).alias("end"), "first_rank", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf_stop") - F.col("leaf_before")).alias("n_leaves"), (F.col("saved_stop") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
