"""Ranks within groups of any size: rows are sorted by ranges of (group, order), so that a large group fills several tasks, and each range continues where the one before it ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the row number of each row within its keys (none: of all rows), by order. Rows that are equal by order get numbers in any order.

    df is written first, as the bounds of the ranges are drawn from it before it is sorted. What is summed up, and broadcast, is one row for each range and group in it; a group that isn't cut needs no more than its own first place.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    placed = written(df, "unranked").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__range", F.shiftright("__at", 33)), "ranked")
    groups = placed.groupBy("__range", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(F.broadcast(starts), same).withColumn(name, F.col("__at") - F.col("__first") + F.col("__ahead") + 1).select(*df.columns, name)
