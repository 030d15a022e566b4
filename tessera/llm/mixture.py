"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source; a source's repetition rate is its target over
its size; each document is taken floor(rate) times plus once more if a hash of
its identifier, its text and the seed, as a number in [0, 1), is below the fraction.

Targets: sources in order of code points (null last) weigh weights[0],
weights[1], ... repeating, and share `budget` times all tokens; a target stops
at `most` times its source's size, and the excess goes to the others by
weight.  Filling in order of size over weight gives that in one pass: a source
is full if what is left, shared by the weights left, reaches its limit.

Defined results: a null text has size 0; a null source is a source of its own;
rows of equal doc_id (null included) and text share their hash.  Sources of size 0
have target 0.  Other columns are kept by `mix` and not read.  An empty table
gives no rows.  The table of sources, one row each, is ordered by ranges, so that
sources may be as many as hosts.  It is broadcast if it takes at most BROADCAST
bytes, which are summed up first, so that documents stay in the tasks that read
them: brought together by source, they would make as few tasks as there are
sources, however many documents there are.  With more, they are shuffled by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ordering import running
from tessera.llm.storage import settle, whole_row

WEIGHTS = (5, 2, 1)
BROADCAST = 32 << 20
ROW_BYTES = 100


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target for sizes (source, source_size), one row per source."""
    cycle = F.array(*[F.lit(w) for w in weights])
    named = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weighed = named.select(
        "source",
        "source_size",
        F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    )
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = running(weighed, order, {"before": F.col("source_size"), "weight_before": F.col("weight")})
    total = filled.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
    ).first()
    left = F.lit(total["size"]) * F.lit(budget) - F.col("before") * most
    filled = filled.withColumn("left", left).withColumn("weight_left", F.lit(total["weight"]) - F.col("weight_before"))
    limit = (F.col("source_size") * most).cast("double")
    filled = filled.withColumn("full", limit * F.col("weight_left") <= F.col("weight") * F.col("left"))
    # the first source that is not full sets the level for all after it
    key = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    level = filled.filter("not full").agg(F.min_by(F.struct("left", "weight_left"), key).alias("level")).first()["level"]
    if level is None:
        return filled.select("source", "source_size", limit.alias("target"))
    share = F.col("weight") * F.lit(level["left"]) / F.lit(level["weight_left"])
    return filled.select("source", "source_size", F.when(F.col("full"), limit).otherwise(F.least(limit, share)).alias("target"))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from a document's identifier and text: 32 bits of MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def rated(sized: DataFrame, weights: tuple[int, ...], budget: float, most: int, held: int) -> DataFrame:
    """sized (source, size, u and others) with source_size, target and copies; sources are broadcast up to held bytes."""
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    named = sources.select(F.col("source").alias("of_source"), "source_size", "target")
    small = (named.agg(F.sum(F.coalesce(F.octet_length("of_source"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0) <= held
    joined = sized.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(F.col("u") < rate - whole, 1).otherwise(0)).cast("int")).drop("u")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """row, doc_id, source, size and u of docs."""
    own = docs.select(whole_row(docs).alias("row")).select(
        "row",
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("row.text").cast("string").alias("text"),
        F.col("row.source").cast("string").alias("source"),
    )
    return own.select(
        "row",
        "doc_id",
        "source",
        size_of(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), F.col("text"), seed).alias("u"),
    )


def rates(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = 1.5,
    most: int = 2,
    seed: int = 7,
    held: int = BROADCAST,
) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row of docs; texts are read once."""
    return rated(settle(sized(docs, seed).drop("row")), weights, budget, most, held)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = 1.5,
    most: int = 2,
    seed: int = 7,
    held: int = BROADCAST,
) -> DataFrame:
    """The mix itself: the columns of docs, each document as many times as it is taken."""
    taken = rated(sized(docs, seed), weights, budget, most, held).select("row", "copies").filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
