"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import settle


def stars(links: DataFrame) -> DataFrame:
    """id, component for every id of links (a, b); component is the smallest id that can be reached.

    Each step is three shuffles: two bring a node's links together, where the
    least of them is found without a join, and one drops repeated links.  A node's
    links are spilled when they are many; no component is gathered in one place.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    of_node, state = Window.partitionBy("a"), None
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        large = both.withColumn("m", F.least(F.min("b").over(of_node), F.col("a"))).filter("b > a").select(
            F.col("b").alias("a"),
            F.col("m").alias("b"),
        )
        small = large.withColumn("m", F.min("b").over(of_node))
        # a node's own link to its least neighbour, and that of each other neighbour
        ends = F.explode(F.array_distinct(F.array("a", "b")))
        edges = settle(small.select(ends.alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
