"""Consecutive numbers over a distributed order, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import written


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder, computed once."""
    return written(df, "rows")


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """df with a column of consecutive numbers in the order given, which should be total.

    Rows are range-partitioned and sorted; a partition's numbers begin after the counts of those before it. The counts,
    one row per partition, are broadcast. The sorted rows are written first, so ranges and counts belong together."""
    inner = F.monotonically_increasing_id()
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", inner))
    part = F.shiftright("_m", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + start).drop("_m", "_p", "_before")
