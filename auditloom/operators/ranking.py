"""Ranks over whole tables without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: monotonically_increasing_id() has the partition above these bits, the row in it below.
ROW_BITS = 33


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's rank, from 1, within its group by an order without ties.

    Rows are dealt out by ranges of group and order and sorted there, so a large group is
    spread over many tasks. A row's place is its place in its range plus the rows of the ranges before:
    one number a range comes to the driver. A group's ranks start at its least place.
    """
    keys = [*(F.asc_nulls_first(g) for g in groups), *order]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place_", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place_", ROW_BITS)
    before, offsets = 0, []
    for k, n in sorted((r["k"], r["count"]) for r in placed.groupBy(part.alias("k")).count().collect()):
        offsets.append((k, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "part_ long, before_ long")
    at = placed.withColumn("part_", part.cast("long")).join(F.broadcast(starts), "part_").withColumn("place_", F.col("before_") + F.col("place_").bitwiseAND((1 << ROW_BITS) - 1)).drop("part_", "before_")
    if not groups:
        return at.withColumn(name, F.col("place_") + 1).drop("place_")
    same = [F.col(f"at.{g}").eqNullSafe(F.col(f"first.{g}")) for g in groups]
    least = at.groupBy(*groups).agg(F.min("place_").alias("least_"))
    test = same[0]
    for t in same[1:]:
        test &= t
    return at.alias("at").join(least.alias("first"), test).select("at.*", (F.col("place_") - F.col("least_") + 1).alias(name)).drop("place_")
