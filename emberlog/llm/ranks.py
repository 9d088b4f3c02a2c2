"""Places and prefix sums of rows in an order, with no group in one task.

Rows are range-partitioned by group and order, sorted and written with a rising number. Rows of one group are
consecutive in each partition, so a place is that number less the first one of group and partition, plus the counts of the
partitions before. One row for each partition and group ties them together, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import materialize

#: Bits of a rising number that count within its partition, fixed by Spark.
WITHIN = 33


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """df with `place` (from 0, within its group), `n` (rows of the group), and for each column x of sums `x_before`, the sum over the rows before.

    Group columns hold no null. Rows that are equal in group and order stand in any order, which is fixed once
    they are written. An empty df stays empty.
    """
    keys = [*group, *order]
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", WITHIN))
    totals = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.sum(x).alias(f"_{x}") for x in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_{x}_base") for x in sums]
    bases = totals.select("_part", *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*group)).alias("n"), *carried)
    if sums:
        running = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"_{x}_run": F.coalesce(F.sum(x).over(running), F.lit(0)) for x in sums})
    found = rows.join(bases, ["_part", *group])
    return found.select(*df.columns, (F.col("_base") + F.col("_at") - F.col("_first")).alias("place"), "n", *[(F.col(f"_{x}_base") + F.col(f"_{x}_run")).alias(f"{x}_before") for x in sums])
