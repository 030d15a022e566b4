"""Running sums over a table in one order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import settle


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with a column for each of values (whole numbers): its sum over all rows before, in an order that has no ties.

    Rows are dealt into ranges and written down; each range has its own running
    sums, and what stands before a range comes from the ranges' totals, one row
    for each partition.
    """
    names = list(values)
    valued = df.select("*", *[v.cast("long").alias(f"value {n}") for n, v in values.items()])
    ranged = settle(valued.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(*[F.sum(f"value {n}").alias(n) for n in names])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("range").alias("of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"offset {n}") for n in names])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), F.col("range") == F.col("of"))
    own = [(F.coalesce(F.sum(f"value {n}").over(inside), F.lit(0)) + F.col(f"offset {n}")).alias(n) for n in names]
    return joined.select(*df.columns, *own)


def following(df: DataFrame, order: list[str]) -> DataFrame:
    """df with next: the columns of order in the row after, as one value, in an order that has no ties (nulls first); null in the last."""
    ranged = settle(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    heads = ranged.groupBy("range").agg(F.min(F.struct(*order)).alias("head"))
    # one row for each partition
    later = heads.select(F.col("range").alias("of"), F.lead("head").over(Window.orderBy("range")).alias("head"))
    inside = F.lead(F.struct(*order)).over(Window.partitionBy("range").orderBy(*order))
    joined = ranged.join(F.broadcast(later), F.col("range") == F.col("of"))
    return joined.select(*df.columns, F.coalesce(inside, F.col("head")).alias("next"))
