"""Substring dedup: word windows that occur more than once are cut out.

Suffixes are split by prefix into groups that fit in memory, and each group's
suffixes are sorted and compared with their neighbours: the nodes of its
suffix tree that are at least a window deep are the maximal repeats.

Not every suffix is moved.  In each window the first of its smallest
PREFIX-word hashes is its anchor, so equal windows have equal anchors at equal
places, and only suffixes around anchors whose prefix occurs more than once
anywhere can hold a repeat:

1. each document sends its distinct anchor prefixes with their counts; prefixes
   that occur once are leaves near the root and end here;
2. the documents that hold others send, for each such anchor, the words of the
   windows around it.  Prefixes have variable length: PREFIX words where at most
   GROUP suffixes share them.  Where more do, a window holds the anchor with
   either half of its other words on one side, so that longer prefixes of the
   anchor and those words, to the left and to the right, split its windows;
3. groups of equal prefixes are sorted in memory, in the order of their words,
   and their deep nodes give the repeated windows;
4. suffixes that more than GROUP share even the longer prefix with are dealt at
   random to groups of about that size.  What such a group does not resolve by
   itself may repeat in another: it names each window once, and windows that
   two groups name are repeated where they were not resolved;
5. the words of repeated windows go back to their documents.

In trees windows are compared by their words.  Prefixes are told apart by one
64-bit hash, which only brings suffixes together; windows that groups name by
two, over different hashes of their words.  Rows are told apart by
doc_id and a hash of the text.

Defined results: a null or empty text has no words; rows of equal doc_id and
text are separate occurrences, so their windows repeat and go in all of them; a
null doc_id is a value like any other; a text shorter than a window is kept.
Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import give_back, release, remove, settle, small_batches, written
from tessera.llm.textops import BASE, OTHER_BASE, buffers, chunks, gram_hashes, mix, ragged, space_table, squeezed, word_hashes, words

WINDOW = 35
PREFIX = 8
GROUP = 1024
SUFFIXES = 60_000


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Of each anchor in some rows' words: place, first and last window start, prefix hash and row."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams = gram_hashes(hashes, prefix)
    span = window - prefix + 1
    if len(grams) < span:
        return none
    best, width = np.arange(len(grams)), 1
    while width < span:
        shift = min(width, span - width)
        a, b = best[:-shift], best[shift:]
        best = np.where(grams[b] < grams[a], b, a)
        width += shift
    starts = ragged(first[:-1], np.maximum(np.diff(first) - window + 1, 0))
    if not len(starts):
        return none
    at = best[starts]
    row = np.searchsorted(first, starts, "right") - 1
    change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    return at[change], starts[change], starts[np.append(change[1:], len(starts)) - 1], grams[at[change]], row[change]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def prefixes(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """did, rid, key, n: the distinct anchor prefixes of each row."""

    def run(batches):
        table = space_table()
        for batch in batches:
            did, rid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = buffers(batch.column(2))
            for low, _, raw, own in chunks(data, offsets):
                begin, end, first = words(raw, own, table)
                _, _, _, key, row = anchors(word_hashes(raw, begin, end), first, window, prefix)
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                at = np.flatnonzero(
                    np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))),
                ) if len(key) else np.zeros(0, np.int64)
                of = low + row[at]
                yield pa.RecordBatch.from_pydict(
                    {
                        "did": pa.array(did[of]),
                        "rid": pa.array(rid[of]),
                        "key": signed(key[at]),
                        "n": pa.array(np.diff(np.append(at, len(key)))),
                    },
                )

    return rows.select("did", "rid", "text").mapInArrow(run, "did long, rid long, key long, n long")


def halves(
    at: np.ndarray,
    start: np.ndarray,
    last: np.ndarray,
    hashes: np.ndarray,
    window: int,
    prefix: int,
) -> list[tuple[np.ndarray, ...]]:
    """(which anchors, their longer prefix, first and last window start) for windows with more words to the right of the anchor, and to the left."""
    more = (window - prefix + 1) // 2
    grams = gram_hashes(hashes, prefix + more)
    out = []
    low = np.maximum(start, at + prefix + more - window)
    which = np.flatnonzero(low <= last)
    out.append((which, mix(grams[at[which]] + np.uint64(1)), low[which], last[which]))
    high = np.minimum(last, at + prefix + more - window - 1)
    which = np.flatnonzero(start <= high)
    out.append((which, mix(grams[at[which] - more] + np.uint64(2)), start[which], high[which]))
    return out


def suffixes(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """For rows (did, rid, text, wanted: array of (key, hot)): the words of the windows around wanted anchors, by their prefix, or by longer ones if hot."""

    def run(batches):
        table = space_table()
        for batch in batches:
            did, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "rid"))
            wanted = batch.column("wanted")
            lists = wanted.offsets.to_numpy()
            flat = wanted.values
            keys = flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64)
            hot = flat.field("hot").to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("text"))
            for low, high, raw, own in chunks(data, offsets):
                begin, end, first = words(raw, own, table)
                hashes = word_hashes(raw, begin, end)
                at, start, last, key, row = anchors(hashes, first, window, prefix)
                pick, is_hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
                bounds = np.searchsorted(row, np.arange(high - low + 1))
                for i in range(high - low):
                    a, b = bounds[i], bounds[i + 1]
                    mine = slice(lists[low + i], lists[low + i + 1])
                    pick[a:b] = np.isin(key[a:b], keys[mine])
                    is_hot[a:b] = np.isin(key[a:b], keys[mine][hot[mine]])
                cold, warm = np.flatnonzero(pick & ~is_hot), np.flatnonzero(is_hot)
                parts = [(cold, key[cold], start[cold], last[cold])]
                if len(warm):
                    parts += [(warm[w], k, s, e) for w, k, s, e in halves(at[warm], start[warm], last[warm], hashes, window, prefix)]
                for hot_part, (which, its, s, e) in enumerate(parts):
                    base, of = first[row[which]], low + row[which]
                    text = [raw[i:j].tobytes() for i, j in zip(begin[s].tolist(), end[e + window - 1].tolist(), strict=True)]
                    columns = {
                        "hot": pa.array(np.full(len(which), hot_part > 0)),
                        "did": pa.array(did[of]),
                        "rid": pa.array(rid[of]),
                        "key": signed(its),
                        "start": pa.array((s - base).astype(np.int32)),
                        "last": pa.array((e - base).astype(np.int32)),
                        "words": pa.array(text, pa.binary()),
                    }
                    yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return rows.mapInArrow(run, "hot boolean, did long, rid long, key long, start int, last int, words binary")


def ranks(texts: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words of all texts, one after the other."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, chain.from_iterable(t.split() for t in texts)), ">u4")


def deep_nodes(sizes: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Sorts all suffixes of some whole groups; (record, place in it, whether under a node a window deep, whether the first of its node) of each."""
    counts = sizes - window + 1
    places = np.cumsum(sizes) - sizes
    at = ragged(places, counts)
    record = np.repeat(np.arange(len(sizes)), counts)
    tree = np.ascontiguousarray(text[at[:, None] + np.arange(window)])
    order = np.argsort(tree.view(f"S{4 * window}").ravel(), kind="stable")
    near = tree[order]
    same = near[1:] == near[:-1]
    depth = np.where(same.all(axis=1), window, same.argmin(axis=1))
    node = depth >= window
    deep, opens = np.zeros(len(at), bool), np.zeros(len(at), bool)
    deep[order[1:][node]] = True
    deep[order[:-1][node]] = True
    if len(order):
        opens[order[np.concatenate(([True], ~node))]] = True
    return record, at - places[record], deep, opens


def solved(table: pa.Table, window: int):
    """The repeated words of some whole groups as (did, rid, first, end), and the windows that split groups name."""
    start = table.column("start").to_numpy().astype(np.int64)
    sizes = (table.column("last").to_numpy() - start) + window
    did, rid = table.column("did").to_numpy(), table.column("rid").to_numpy()
    record, place, deep, opens = deep_nodes(sizes, ranks(table.column("words").to_pylist()), window)
    # a record's windows all hold its anchor, so what they cover is one interval
    hit = np.flatnonzero(deep)
    edge = np.flatnonzero(np.concatenate(([True], record[hit][1:] != record[hit][:-1]))) if len(hit) else hit
    of, first = record[hit[edge]], place[hit[edge]]
    end = place[hit[np.append(edge[1:], len(hit)) - 1]] + window if len(hit) else first
    none = pa.nulls(len(of), pa.int64())
    yield {
        "did": pa.array(did[of]),
        "rid": pa.array(rid[of]),
        "first": pa.array((start[of] + first).astype(np.int32)),
        "end": pa.array((start[of] + end).astype(np.int32)),
        "one": none,
        "two": none,
    }
    split = table.column("split").to_numpy()
    if not split.any():
        return
    named = np.flatnonzero(split[record] & (opens | ~deep))
    of, where = record[named], place[named]
    data, offsets = buffers(table.column("words"))
    begin, stop, firsts = words(data, offsets, space_table())
    one, two = (gram_hashes(word_hashes(data, begin, stop, base), window)[firsts[of] + where] for base in (BASE, OTHER_BASE))
    low, done = (start[of] + where).astype(np.int32), deep[named]
    yield {
        "did": pa.array(did[of], mask=done),
        "rid": pa.array(rid[of], mask=done),
        "first": pa.array(low),
        "end": pa.array(low + np.int32(window)),
        "one": signed(one),
        "two": signed(two),
    }


def in_groups(found: DataFrame, window: int) -> DataFrame:
    """What `solved` gives for suffixes sorted by group inside each partition."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        total = 0
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                held.append(batch)
                total += int((batch.column("last").to_numpy() - batch.column("start").to_numpy()).sum()) + batch.num_rows
                if total < SUFFIXES:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("group").to_numpy()
                cut = int(np.flatnonzero(key == key[-1])[0])  # the last group may go on
                if cut:
                    yield from map(pa.RecordBatch.from_pydict, solved(table.slice(0, cut), window))
                    held = table.slice(cut).combine_chunks().to_batches()
                    total = int((table.column("last").to_numpy()[cut:] - table.column("start").to_numpy()[cut:] + 1).sum())
        if held:
            yield from map(pa.RecordBatch.from_pydict, solved(pa.Table.from_batches(held), window))
        held.clear()
        give_back()

    sorted_groups = found.repartition("group").sortWithinPartitions("group")
    return sorted_groups.select("did", "rid", "group", "split", "start", "last", "words").mapInArrow(
        run,
        "did long, rid long, first int, end int, one long, two long",
    )


def cut_out(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, removed for rows (doc_id, text, spans)."""

    def run(batches):
        table = space_table()
        for batch in batches:
            spans = batch.column("spans")
            lists, flat = spans.offsets.to_numpy(), spans.values
            lows, highs = flat.field("first").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("text"))
            for low, high, raw, own in chunks(data, offsets):
                begin, end, first = words(raw, own, table)
                mark = np.zeros(len(begin) + 1, np.int32)
                of = np.repeat(np.arange(low, high), np.diff(lists[low : high + 1])) - low
                mine = slice(lists[low], lists[high])
                np.add.at(mark, first[of] + lows[mine], 1)
                np.add.at(mark, first[of] + highs[mine], -1)
                gone = np.cumsum(mark[:-1]) > 0
                keep = np.flatnonzero(~gone)
                left = np.searchsorted(keep, first)
                text, places = squeezed(raw, begin[keep], end[keep], left)
                kept = [text[places[i] : places[i + 1]].tobytes() for i in range(high - low)]
                removed = []
                for i in range(high - low):
                    part = np.concatenate(([False], gone[first[i] : first[i + 1]], [False])).astype(np.int8)
                    step = np.flatnonzero(np.diff(part))
                    removed.append([{"first_word": int(a), "end_word": int(b)} for a, b in zip(step[::2], step[1::2], strict=True)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(low, high - low),
                        "n_words": pa.array(np.diff(first)),
                        "n_removed": pa.array(np.diff(first) - np.diff(left)),
                        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
                        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                        "removed": pa.array(removed, pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))),
                    }
                )

    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<first_word: int, end_word: int>>",
    )


def repeated(rows: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """did, rid, spans: the word ranges of each row that repeated windows cover."""
    spark = rows.sparkSession
    keys = prefixes(rows, window, prefix)
    often = keys.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1").select("key", (F.col("times") > group).alias("hot"))
    often = settle(often)  # a plain table, so that a frequent prefix's side of the join can be split
    wanted = keys.select("did", "rid", "key").join(often, "key").groupBy("did", "rid").agg(
        F.collect_set(F.struct("key", "hot")).alias("wanted"),
    )
    wanted = settle(wanted)
    found, path = written(suffixes(rows.join(wanted, ["did", "rid"]), window, prefix), "suffixes")
    many = found.filter("hot").groupBy("key").agg(F.ceil(F.count("*") / group).alias("parts")).filter("parts > 1")
    many = settle(many)  # so that a frequent key's side of the join can be split
    cold = found.filter("not hot").withColumn("group", F.col("key")).withColumn("split", F.lit(False))
    part = F.pmod(F.xxhash64("did", "rid", "start"), F.coalesce("parts", F.lit(1)))
    warm = found.filter("hot").join(many, "key", "left").withColumn("group", F.xxhash64("key", part)).withColumn(
        "split",
        F.col("parts").isNotNull(),
    ).drop("parts")
    solutions, answers = written(in_groups(cold.unionByName(warm), window), "repeats")
    remove(spark, path)
    named = solutions.filter("one is not null")
    again = settle(named.groupBy("one", "two").agg(F.count("*").alias("times")).filter("times > 1").select("one", "two"))
    across = named.filter("did is not null").join(again, ["one", "two"], "left_semi")
    ranges = solutions.filter("one is null").unionByName(across).groupBy("did", "rid")
    spans = settle(ranges.agg(F.collect_set(F.struct("first", "end")).alias("spans")))
    remove(spark, answers)
    return spans


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """One row per row of docs (doc_id, text), in the columns of `cut_out`."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("did", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("rid", F.xxhash64("text"))
    spans = repeated(rows, window, prefix, group)
    release(docs.sparkSession)  # of what the steps before have written
    empty = F.array().cast("array<struct<first: int, end: int>>")
    return cut_out(rows.join(spans, ["did", "rid"], "left").select("doc_id", "text", F.coalesce("spans", empty).alias("spans")))
