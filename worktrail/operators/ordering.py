"""Ranks inside groups that stay whole when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worktrail.session import pinned


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First n rows per group. Spark cuts each map task's groups to n rows before the
    shuffle, so a hot group sends n rows per task and no more."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def group_positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds pos (0-based place in the group) and group_rows without sorting a group in
    one task: range-partition on the full key, number rows inside each range, then add
    the rows of the earlier ranges. The range id must not change between the two reads,
    so the narrow ranged table is written to the checkpoint folder first.

    ``order`` has to be unique inside a group.
    """
    return group_offsets(df, keys, order, F.lit(1)).withColumnsRenamed({"offset": "pos", "group_total": "group_rows"})


def group_offsets(df: DataFrame, keys: list[str], order: list[str], weight: Column) -> DataFrame:
    """Adds offset (sum of ``weight`` over the rows before, in the group's order) and
    group_total, by ranges as group_positions does."""
    ranged = pinned(df.withColumn("_weight", weight.cast("long")).repartitionByRange(*keys, *order).withColumn("range_id", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "range_id").agg(F.sum("_weight").alias("range_sum"))
    # One row per group and range: at most groups + ranges rows in all.
    before = W.partitionBy(*keys).orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = sizes.select(
        *keys,
        "range_id",
        F.coalesce(F.sum("range_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("range_sum").over(whole).alias("group_total"),
    )
    inside = W.partitionBy(*keys, "range_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        ranged.withColumn("_inside", F.sum("_weight").over(inside) - F.col("_weight"))
        .join(offsets, [*keys, "range_id"])
        .withColumn("offset", F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_weight", "range_id")
    )


def joined_list(order: Column, value: Column, where: Column | None = None) -> Column:
    """Aggregate: values of a bounded group in the given order."""
    item = F.struct(order.alias("o"), value.alias("v"))
    if where is not None:
        item = F.when(where, item)
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])


def beside(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the columns of one-row tables to every row, as scalar subqueries: each is
    computed once and no join is planned."""
    for part in one_row:
        value = part.select(F.struct(*part.columns).alias("s")).scalar()
        df = df.withColumn("_beside", value).select("*", "_beside.*").drop("_beside")
    return df
