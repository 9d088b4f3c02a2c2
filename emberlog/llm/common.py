"""What several operators share: tables in the shared folder, hashes, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder of spark.checkpoint.dir. Where that is unset, as in tests on one machine,
    a temporary folder is made and set for the session; on a cluster no folder of one machine will do, so it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/emberlog/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: later steps neither repeat its work nor lose it with an executor."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """The words of a text: runs of anything but \\x20 and \\x09-\\x0D. Null and blank texts have none."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: A key counts as hot if it holds more than one of so many rows, so there are fewer hot keys than this.
HOT = 1024


def look_up(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the other columns of found, null where it has nothing for them. No key gathers in one task.

    found is a written table, unique by `on`, with n: how many rows have the key. Fewer than HOT keys hold more than
    the HOT-th part of all those rows, so they are broadcast; their rows are dealt by a hash of the whole row in
    the join that looks up the others.
    """
    total = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    others = [c for c in found.columns if c not in (*on, "n")]
    values = F.struct(*others) if others else F.struct(F.lit(True).alias("there"))
    keyed = found.select(*on, "n", values.alias("_value"))
    hot = keyed.where(F.col("n") * HOT > total).select(*on, F.col("_value").alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    marked = marked.withColumn("_spread", F.coalesce(spread, F.lit(0).cast("long")))
    cold = keyed.where(F.col("n") * HOT <= total).select(*on, F.lit(0).cast("long").alias("_spread"), F.col("_value").alias("_cold"))
    value = F.coalesce("_hot", "_cold")
    joined = marked.join(cold.hint("merge"), [*on, "_spread"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[value[c].alias(c) for c in others] if others else [value.isNotNull().alias("there")])


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with an operator's own. A missing name is an error."""
    return df.select(*[F.col(f"`{n}`") for n in names])
