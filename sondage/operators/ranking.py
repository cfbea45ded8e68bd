"""Exact ranks inside groups of any size.

A window partitioned by the group would put a group that holds a third of all rows into one task. Here rows are range
partitioned by group and order, so that a large group spans many partitions; a row's rank is its place in its partition
plus the rows of its group in the partitions before, and only the per-partition counts meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondage.storage import written


def global_rank(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rank", size: str = "group_size") -> tuple[DataFrame, DataFrame]:
    """Rows with ``rank`` (1, 2, ... by ``order``) and ``size``, and the parts table (_pid, groups, ...).

    ``order`` must be total for a defined result: end it with a unique key. The rows keep ``_pid``, so that anything
    known per group can be joined through ``per_part`` on (_pid, groups), a key that no hot group makes heavy.
    """
    cut = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    rows = written(cut.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_pos", 33)), "ranked")
    parts = rows.groupBy("_pid", *groups).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).withColumn(size, F.sum("_count").over(Window.partitionBy(*groups)))
    ranked = rows.join(parts.drop("_count"), ["_pid", *groups]).withColumn(rank, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
    return ranked.drop("_pos", "_first", "_before"), parts.select("_pid", *groups)


def per_part(parts: DataFrame, known: DataFrame, groups: list[str]) -> DataFrame:
    """What is ``known`` per group, for every part of the group: at most one row per partition more than groups."""
    return parts.join(known, groups)


def median_of(ranked: DataFrame, groups: list[str], value: str, rank: str = "rank", size: str = "group_size") -> Column:
    """Aggregate over ``ranked``: the mean of the middle one or two values."""
    return F.avg(F.when((F.col(rank) * 2 >= F.col(size)) & (F.col(rank) * 2 <= F.col(size) + 2), F.col(value)))
