"""Exact dedup by content sort, in DataFrame operations only.

Rows are ordered by (the first PREFIX characters of the content, its hash, the
content).  Sampled splitters range-partition them by the first two, which are
short however long texts are; an external sort places equal contents next to
each other, and a window over the content compares each row with its neighbour
in full.  The row of the best identifier opens its run of equal contents.

A content that more than one in SHARE * partitions of all rows have would fill
a range by itself.  Such contents, fewer than SHARE * partitions, are found by
counting hashes first; their rows get a salt from the identifier as the third
sort key, so that their runs fall into several ranges.  The first rows of those
runs are then grouped by their full content, and what comes out, a row for each
hot content, goes back to the hot rows by broadcast.

Defined results: a null text counts as empty; a null doc_id never wins over
another; if all of a group are null, keep_id is null and one row is kept.  Of
rows with equal text and equal doc_id exactly one is kept (such rows share
their salt).  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import settle

PREFIX = 16
SHARE = 4
LEAST = 64


def hot_contents(keyed: DataFrame, least: int) -> DataFrame:
    """hash, salts of the hashes that more rows have than one of SHARE * partitions, so of fewer than that many."""
    ranges = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(least, keyed.count() // (SHARE * ranges))
    counts = keyed.groupBy("hash").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    return counts.select("hash", F.ceil(F.col("rows") / most).alias("salts"))


def runs(docs: DataFrame, content: Column, keep: str, least: int = LEAST) -> DataFrame:
    """doc_id, text_sha256, salt (null if not hot), and of its run: rank, the best doc_id, the size, and the content in a hot run's first row."""
    text = F.coalesce(content.cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("content")).withColumn("hash", F.xxhash64("content"))
    salted = keyed.join(
        F.broadcast(hot_contents(keyed, least)),
        "hash",
        "left",
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts"))).drop("salts")
    ranged = salted.withColumn("prefix", F.substring("content", 1, PREFIX)).repartitionByRange("prefix", "hash", "salt")
    equal = Window.partitionBy("prefix", "hash", "salt", "content")
    best = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    ordered = equal.orderBy(best)
    ranked = ranged.withColumns(
        {"rank": F.row_number().over(ordered), "run_id": F.first("doc_id").over(ordered), "run_size": F.count("*").over(equal)},
    )
    first = F.when(F.col("salt").isNotNull() & (F.col("rank") == 1), F.col("content"))
    return ranked.select(
        "doc_id",
        F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
        "salt",
        "rank",
        "run_id",
        "run_size",
        first.alias("content"),
    )


def exact_dedup(docs: DataFrame, normalised: Column | None = None, keep: str = "smallest", least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    normalised: the content to compare (default: the text as it is); keep: which
    identifier of a group stays, smallest or largest; least: contents of no more
    rows are never split.
    """
    rows = settle(runs(docs, F.col("text") if normalised is None else normalised, keep, least))
    pick = F.max if keep == "largest" else F.min
    cold = rows.filter("salt is null").select(
        "doc_id",
        F.col("run_id").alias("keep_id"),
        F.col("run_size").alias("group_size"),
        (F.col("rank") == 1).alias("kept"),
        "text_sha256",
    )
    # null identifiers share a salt, so a group of them alone is one run
    groups = rows.filter("content is not null").groupBy("content").agg(
        F.first("text_sha256").alias("text_sha256"),
        pick("run_id").alias("keep_id"),
        F.sum("run_size").alias("group_size"),
    ).drop("content")
    hot = rows.filter("salt is not null").join(F.broadcast(groups), "text_sha256")
    wins = (F.col("rank") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return cold.unionByName(hot.select("doc_id", "keep_id", "group_size", wins.alias("kept"), "text_sha256"))
