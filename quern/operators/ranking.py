"""Exact ranks inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut


def range_partitioned(df: DataFrame, order: list[Column], part: str = "part") -> DataFrame:
    """df sorted over its partitions by order, with the partition's number, written to the checkpoint folder.

    The checkpoint fixes the partition numbers: a task that runs again can't change them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))


def group_ranks(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with each row's 1-based position in its group, in the given total order.

    Rows are range-partitioned by group and order, so that a group of a third of all rows is spread over a third
    of the partitions; a row's rank is its place among the group's rows of its partition plus the group's rows in
    earlier partitions. Those offsets come from one row per partition and group. size, if given, names a column
    for the number of rows of the group. Null group values form a group; ties get ranks by the order given, which
    should end with a unique column; an empty df gives an empty result.
    """
    parts = range_partitioned(df, [*(F.col(g) for g in group), *order], "_part")
    whole = Window.partitionBy(*group)
    offsets = (
        parts.groupBy(*group, "_part")
        .count()
        .withColumn("_before", F.sum("count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_size", F.sum("count").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_part").alias("_o_part"), F.coalesce("_before", F.lit(0)).alias("_before"), "_size")
    )
    same = F.col("_part") == F.col("_o_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    placed = parts.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    out = placed.join(offsets, same).withColumn(rank, F.col("_place") + F.col("_before"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_part", "_place", "_before", "_size", "_o_part", *[f"_o_{g}" for g in group])


def group_cdf(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group columns, value, below, upto, size): for each value of a group, exactly how many rows are less, and at most it.

    Equal values are counted first; the distinct ones are range-partitioned and summed up within partitions, and the
    totals of earlier partitions are added. Rows with a null value don't count. Group columns must not be null.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    parts = range_partitioned(counted, [*(F.col(g) for g in group), F.col(value)], "_part")
    whole = Window.partitionBy(*group)
    offsets = (
        parts.groupBy(*group, "_part")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("size", F.sum("_m").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("_m")
    )
    inside = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy(value))
    placed = parts.withColumn("_upto", inside).join(offsets, [*group, "_part"])
    return placed.select(*group, value, (F.col("_before") + F.col("_upto") - F.col("_n")).alias("below"), (F.col("_before") + F.col("_upto")).alias("upto"), "size")
