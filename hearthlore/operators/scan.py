"""Running totals over groups of any size.

A window holds a group in one task. Here rows are ranged over partitions by group and order, so a
large group lies in several of them, one behind the other. Each partition adds up what it has of
a group, the few sums that a group has are added up in turn, and each row has its partition's
share before it and the sums of the partitions before. Only one row a group and partition meets
in a window of the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranged(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """``df`` written in order of group and ``order``, with the number ``part`` of each row's partition."""
    by = [group, *order]
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "ranged")


def chunk(group: str, order: list[Column | str]):
    """The window of what a partition has of a group, over ``ranged`` rows."""
    return Window.partitionBy("part", group).orderBy(*order)


def with_parts(rows: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """``ranged`` rows with the columns of a table of one row a group and partition."""
    parts = parts.withColumnsRenamed({group: "of_group", "part": "of_part"})
    return rows.join(parts, (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group", "of_part")


def running(rows: DataFrame, group: str, order: list[Column | str], **values: Column) -> DataFrame:
    """``ranged`` rows with, for each name, the sum of the values of all rows of the group before this one."""
    before = chunk(group, order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.groupBy(group, "part").agg(*(F.sum(v).alias(f"sum_{n}") for n, v in values.items()))
    parts = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    shares = own.select(group, "part", *(F.coalesce(F.sum(f"sum_{n}").over(parts), zero).alias(f"base_{n}") for n in values))
    joined = with_parts(rows, shares, group)
    sums = {n: F.coalesce(F.sum(v).over(before), zero) + F.col(f"base_{n}") for n, v in values.items()}
    return joined.withColumns(sums).drop(*(f"base_{n}" for n in values))
