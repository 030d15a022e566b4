"""Quality classifier by importance resampling.

Two generative models over hashed tokens and pairs of tokens are counted: one of
a target (documents labelled good), one of the raw text (all documents).  Tokens
are words and runs of punctuation.  A document's weight is the sum of
log(target / raw) over its n-grams.

Documents are dealt to FOLDS by a hash of doc_id, and each is scored by a target
model that was counted on the good rows of the other folds only.  So weights of
labelled and of unlabelled documents mean the same, and the good rows tell what
clean documents that no model has seen would get.  A sum's mean grows with the
number of n-grams and its spread with the root of it: the key is the weight less
that mean, over that spread (both measured on the good rows), plus Gumbel noise.
Resampling without replacement takes the k documents with the largest keys.

k is given, or found from labels: as many rows as reach the key that all but a
given share of the documents labelled good have, by a model that did not count
them.  Of rows that tie at the k-th key all are in the sample, which can then be
larger than k: rows of one doc_id and equal weight.  The noise is a hash of
doc_id and seed, so reruns agree.  All labelled rows and every whole text are counted.  The
ids labelled good are broadcast if there are at most BROADCAST of them, which is
counted first; with more, texts are shuffled by doc_id to count the target.

Defined results: a null or empty text has no n-grams and weight 0; rows of
equal doc_id share their noise; a null doc_id has noise of its own; labels
that are null count as not good and not bad; a doc_id labelled more than once is
good if one of its labels is.  Without good rows in two folds at least there is
nothing to measure on: all weights are 0 and every row is kept.  Columns beyond doc_id and text are
passed on by `resample`.  An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import give_back, settle, small_batches, whole_row
from tessera.llm.textops import alnum_table, buffers, chunks, gram_hashes, lower_table, space_table, word_hashes

BITS = 16
FOLDS = 5
BROADCAST = 1_000_000
MISSED = 0.005
SMOOTH = 0.5


def kinds_table() -> np.ndarray:
    """0 for white space, 1 for bytes of words, 2 for all else."""
    return np.where(alnum_table(), 1, np.where(space_table(), 2, 0)).astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of one kind of bytes other than white space start and end, and for each row the index of its first."""
    kinds = table[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = kinds[1:] != kinds[:-1]
    fresh[offsets] = True
    begin = np.flatnonzero(fresh[:-1] & (kinds > 0))
    return begin, np.flatnonzero(fresh[1:] & (kinds > 0)) + 1, np.searchsorted(begin, offsets)


def buckets(raw: np.ndarray, rows: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of some rows, and the row of each."""
    raw = lower[raw]
    begin, end, first = tokens(raw, rows, kinds)
    hashes = word_hashes(raw, begin, end)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    pairs = gram_hashes(hashes, 2)
    same = row[1:] == row[:-1]
    grams = np.concatenate([hashes, pairs[same]]) if len(pairs) else hashes
    return (grams >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, row[:-1][same]]) if len(pairs) else row


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """The fold of a row; any for a null doc_id, which no label can name."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.lit(3)), F.lit(folds)).cast("int")


def counted(docs: DataFrame, by: Column | None = None, folds: int = 1) -> np.ndarray:
    """How often each bucket occurs in the texts of docs, a line for each fold: summed in each task, then by fold and bucket."""

    def run(batches):
        kinds, lower, total = kinds_table(), lower_table(), np.zeros(folds << BITS, np.int64)
        for batch in batches:
            of = batch.column(1).to_numpy()
            for low, high, raw, rows in chunks(*buffers(batch.column(0))):
                at, row = buckets(raw, rows, kinds, lower)
                total += np.bincount((of[low:high].astype(np.int64)[row] << BITS) + at, minlength=folds << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})
        give_back()

    counts = np.zeros(folds << BITS, np.int64)
    texts = docs.select(F.col("text").cast("string"), (F.lit(0) if by is None else by).alias("fold"))
    sums = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return counts.reshape(folds, 1 << BITS)


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the rows labelled good: high quality and not toxic."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def those_of(rows: DataFrame, good: DataFrame, small: bool) -> DataFrame:
    """The rows whose doc_id is labelled good."""
    return rows.join(F.broadcast(good) if small else good.hint("merge"), "doc_id", "left_semi")


def model(docs: DataFrame, good: DataFrame, folds: int = FOLDS) -> np.ndarray:
    """log(target / raw) of each bucket, a line for each fold: the target counted on good outside of that fold."""
    of = counted(good, fold(F.col("doc_id"), folds), folds)
    if (of.sum(axis=1) > 0).sum() < 2:
        return np.zeros((folds, 1 << BITS))
    target, raw = of.sum(axis=0) - of, np.maximum(counted(docs), of.sum(axis=0))
    smooth = lambda c: np.log(c + SMOOTH) - np.log(c.sum(axis=1, keepdims=True) + SMOOTH * c.shape[1])
    return smooth(target) - smooth(raw)


def gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    return -F.log(-F.log(u))


def scored(docs: DataFrame, ratios: np.ndarray, seed: int = 11, centre: float = 0.0, spread: float = 1.0) -> DataFrame:
    """docs with log_weight, n_grams and key (log_weight less its mean for so many n-grams, over its spread, plus noise)."""
    ratios = ratios.reshape(-1, 1 << BITS)
    own = docs.select(
        whole_row(docs).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        fold(F.col("doc_id"), len(ratios)).alias("fold"),
    )
    text = docs.columns.index("text")
    schema = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("id", T.LongType()),
            T.StructField("log_weight", T.DoubleType()),
            T.StructField("n_grams", T.LongType()),
        ],
    )

    def run(batches):
        kinds, lower = kinds_table(), lower_table()
        for batch in batches:
            data, offsets = buffers(batch.column(0).field(text))
            of = batch.column(2).to_numpy()
            for low, high, raw, rows in chunks(data, offsets):
                at, row = buckets(raw, rows, kinds, lower)
                weight = np.bincount(row, ratios[of[low:high][row], at], high - low).astype(np.float64)  # without words numpy gives integers
                many = np.bincount(row, minlength=high - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(weight), pa.array(many)],
                    names=["row", "id", "log_weight", "n_grams"],
                )
        give_back()

    made = own.mapInArrow(run, schema)
    return made.withColumn("key", scaled(centre, spread) + gumbel(F.col("id"), seed))


def scaled(centre: float, spread: float) -> Column:
    """log_weight on a scale that is the same for texts of any length."""
    return (F.col("log_weight") - F.lit(centre) * F.col("n_grams")) / (F.lit(spread) * F.sqrt(F.greatest(F.col("n_grams"), F.lit(1))))


def measured(held: DataFrame) -> tuple[float, float]:
    """The mean weight of an n-gram in rows of held, and the spread of a weight over the root of its n-grams."""
    w, n = F.col("log_weight"), F.col("n_grams")
    r = held.filter("n_grams > 0").agg(F.sum(w).alias("w"), F.sum(n).alias("n"), F.count("*").alias("rows")).first()
    if not r["rows"]:
        return 0.0, 1.0
    centre = r["w"] / r["n"]
    square = held.filter("n_grams > 0").agg(F.avg((w - F.lit(centre) * n) ** 2 / n)).first()[0]
    return float(centre), float(square) ** 0.5 or 1.0


def level_of_top(keys: DataFrame, k: int) -> float:
    """The k-th largest key, exactly: each pass counts keys in 65,536 slots of the range that is left."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    while True:
        step = (high - low) / 65536
        if step <= 0 or low + step == low:
            return low
        slot = F.least(F.floor((F.col("key") - low) / step), F.lit(65535))
        counts = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(slot.alias("slot")).agg(
            F.count("*").alias("n"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
        ).orderBy(F.desc("slot")).collect()
        for r in counts:
            if r["n"] >= k:
                break
            k -= r["n"]
        else:
            return low
        if r["low"] == r["high"] or r["n"] == k:
            return r["low"]
        low, high = r["low"], r["high"]


class Draw(NamedTuple):
    """A sample: the numbers of each row (id, log_weight, n_grams, key), the least key in it, and what scores a row."""

    numbers: DataFrame
    least: float
    ratios: np.ndarray
    centre: float
    spread: float


def draw(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    missed: float = MISSED,
    seed: int = 11,
    folds: int = FOLDS,
    most: int = BROADCAST,
) -> Draw:
    """The k rows of docs (doc_id, text) with the largest keys; k as given, or the number of rows
    whose key reaches what all but that share of the held-out rows labelled good have."""
    small_batches(docs.sparkSession)
    good = settle(good_ids(labels))
    small = good.limit(most + 1).count() <= most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = model(texts, those_of(texts, good, small), folds)
    # three numbers a row are written, so that no later step reads texts again
    numbers = settle(scored(texts, ratios, seed).select("id", "log_weight", "n_grams"))
    held, (centre, spread) = None, (0.0, 1.0)
    if ratios.any():
        held = settle(those_of(numbers.withColumnRenamed("id", "doc_id"), good, small))
        centre, spread = measured(held)
    numbers = numbers.withColumn("key", scaled(centre, spread) + gumbel(F.col("id"), seed))
    if k is None and held is None:
        return Draw(numbers, float("-inf"), ratios, centre, spread)
    if k is None:
        keys = held.select((scaled(centre, spread) + gumbel(F.col("doc_id"), seed)).alias("key"))
        n = held.count()
        k = numbers.filter(F.col("key") >= F.lit(level_of_top(keys, n - int(missed * n)))).count()
    return Draw(numbers, level_of_top(numbers.select("key"), k), ratios, centre, spread)


def sample(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """id, log_weight, n_grams, key and kept for every row of docs (doc_id, text)."""
    drawn = draw(docs, labels, **settings)
    return drawn.numbers.withColumn("kept", F.col("key") >= F.lit(drawn.least))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 11, **settings) -> DataFrame:
    """row (all columns of docs), id, log_weight, n_grams, key and kept, for every row of docs."""
    drawn = draw(docs, labels, seed=seed, **settings)
    out = scored(docs, drawn.ratios, seed, drawn.centre, drawn.spread)
    return out.withColumn("kept", F.col("key") >= F.lit(drawn.least))
