"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

Each row's leaf is a digest of its fields. Leaves of a group stand in order, and runs of `fan` consecutive nodes become their
parent, level by level, until one node is left, the group's subroot; subroots in the order of their groups are the
leaves of a second tree, whose top is the root. A level is one window partitioned by group and parent index: its ordered
list over the full frame is the parent's preimage, and without the node itself the node's siblings. The first node of each
run alone passes the parent on, so parents are unique without another shuffle.

Places come from ranges of rows (ranks.numbered), so a group of any size is dealt over all tasks; a window's partition holds at most
`fan` rows. Levels shrink by the fan, and texts are never shuffled, only digests. Paths go down the same way: each node's
siblings are put before its parent's path, so leaves are joined once, with a table of a fan-th of their number.

Defined cases: a null field counts as "-"; a null group is the first of the groups; rows of equal order (or without) are ordered by their
leaf, nulls first, so rows that repeat have equal leaves and proofs of their own; an empty table gives no row; a table of one row has its leaf
as root and an empty proof; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, own_columns
from emberlog.llm.ranks import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*fields: Column) -> Column:
    """SHA-256 in hex over the fields, each "-" if null, else its length in bytes, ":" and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Tree:
    """levels: tables of g, i, n, h (group, place, nodes of the group in this level, digest); the first has the leaves' other columns."""

    levels: list[DataFrame]
    fan: int

    def tops(self) -> DataFrame:
        """g, h: the last node of each group."""
        found = [x.where("n = 1").select("g", "h") for x in self.levels]
        out = found[0]
        for x in found[1:]:
            out = out.union(x)
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves with the columns of tops (g, path, ...), path being what stands left and right of the node in each level, from the leaf to the end of tops' path."""
        carried = [c for c in tops.columns if c not in ("g", "path")]
        found = None
        for k, nodes in reversed([*enumerate(self.levels)]):
            kept = nodes.columns if k == 0 else ["g", "i"]
            out = nodes.where("n = 1").join(tops, "g").select(*kept, "path", *carried)
            if found is not None:
                place = F.col("i") % self.fan
                step = F.struct(
                    F.concat_ws("", F.slice("run", F.lit(1), place.cast("int"))).alias("left"),
                    F.concat_ws("", F.slice("run", (place + 2).cast("int"), F.lit(self.fan))).alias("right"),
                )
                above = found.select("g", F.col("i").alias("up"), F.col("path").alias("higher"), *carried)
                risen = _runs(nodes, self.fan).join(above, ["g", "up"])
                out = out.union(risen.select(*kept, F.concat(F.array(step), "higher").alias("path"), *carried))
            found = out
        return found


def _runs(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes that have a parent, with its place `up` and its children's digests `run`."""
    whole = Window.partitionBy("g", "up").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.where("n > 1").withColumn("up", F.expr(f"i div {fan}")).withColumn("run", F.collect_list("h").over(whole))


def grow(leaves: DataFrame, order: list[str], fan: int = 8) -> Tree:
    """The trees over leaves (g, h and other columns), one for each g, in which leaves stand by `order`."""
    first = materialize(numbered(leaves, ["g"], order).withColumnRenamed("place", "i"))
    levels, most = [first], first.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parents = _runs(levels[-1], fan).where(f"i % {fan} = 0")
        levels.append(materialize(parents.select("g", F.col("up").alias("i"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.sha2(F.concat_ws("", "run"), 256).alias("h"))))
        most = -(-most // fan)
    return Tree(levels, fan)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def manifest(docs: DataFrame, presented: Column | None = None, fan: int = 8, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """A row for each document: its id, leaf, path, subroot and root, and the leaf that is presented for it.

    presented: what is to be verified against the manifest in place of the text column, an expression over the fields; the
    documents themselves if None.
    """
    own = own_columns(docs, *dict.fromkeys((*fields, group, order)))
    leaf = leaf_of(*[F.col(f) for f in fields])
    shown = leaf if presented is None else leaf_of(*[presented if f == "text" else F.col(f) for f in fields])
    # Groups as text whose order is that of their bytes, null first; never null themselves.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = own.select(key.alias("g"), F.col(order).alias("id"), leaf.alias("h"), shown.alias("shown"))
    groups = grow(leaves, ["id", "h"], fan)
    whole = grow(groups.tops().select(F.lit("").alias("g"), F.col("g").alias("member"), "h"), ["member"], fan)
    top = whole.tops().select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("root"))
    tops = materialize(whole.paths(top).select(F.col("member").alias("g"), "path", F.col("h").alias("subroot"), "root"))
    return groups.paths(tops).select(F.col("id").alias(order), F.col("h").alias("leaf"), "shown", "path", "subroot", "root")


def verified(found: DataFrame) -> DataFrame:
    """manifest() rows with proof_sha256, folded_root (from the presented leaf) and verified."""
    return found.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.col("shown"), F.col("path"))}).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: str = "text", key: str = "doc_id", every: int = 3) -> Column:
    """A tampered text: A-Z in lower case where the CRC of the decimal id is divisible by `every`; a null id's text stays."""
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))
