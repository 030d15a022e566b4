"""Token-ID output: documents as ids in compressed, checksummed blocks.

Documents are dealt by ranges of doc_id, tokenized in ascending order, and
written as blocks of whole documents.  A block is one row of a Parquet dataset:
shard and number (which order the blocks), the identifiers and lengths of its
documents, the number of ids, and the ids coded by `range_coder`, whose model
is reset in each block.  Spark's own writer commits the files, so a lost
executor or a repeated task leaves no double or partial block.  Blocks are read
in any order and on any executor; where a block starts follows from the counts.

Defined results: a null or empty text is just the end id; a null doc_id comes
first; rows of equal doc_id stand together in the order of a hash of their
text, and repeated rows are repeated.  A document longer than a block is a block
of its own, and its ids are coded in parts that are reset and checked like blocks,
so that memory doesn't grow with it.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.range_coder import pack, unpack
from tessera.llm.storage import USUAL, give_back, keep_freed, shared_folder, small_batches
from tessera.llm.textops import buffers, chunks, ragged

BLOCK_IDS = 1 << 20
END_ID = 0
TEXTS_BYTES = 1 << 19
#: Classes of characters by which the byte-level tokenizer cuts texts before merging, and the endings that it cuts off.
LETTERS, NUMBERS, SPACES = r"\p{L}+", r"\p{N}+", r"\p{White_Space}+"
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The parts of a tokenizer file under which pieces may be encoded one by one.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
FEED = 0x0A
PIECES = 1 << 18
OTHER, LETTER, NUMBER, SPACE, BLANK = 0, 1, 2, 3, 4
TABLE_BITS = 21
CACHED = 1_000_000
CACHED_BYTES = 1 << 24
SHORT = 15

BLOCKS = "shard int, block int, n_ids long, doc_ids array<long>, lengths array<long>, coded binary"


def byte_bpe_50k() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def loaded(path: str):
    """A file's tokenizer, once in a process: the library doesn't return all memory of one that is dropped.

    It works on one thread, as a task has one core.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder in a worker, so that tasks share what it has learned."""
    return Encoder(path)


def byte_letters() -> np.ndarray:
    """How a byte-level vocabulary writes each byte: as the character of that number if that is printable, else as the next from 256 on."""
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = plain[0xA1:0xAD] = plain[0xAE:] = True
    return np.where(plain, np.arange(256), 255 + np.cumsum(~plain)).astype("<u4")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point; BLANK is the space itself."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, LETTERS), (NUMBER, NUMBERS), (SPACE, SPACES)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            table[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[0x20] = BLANK
    return table


def byte_classes(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The class of each byte's character, and which bytes continue one (None if no byte does)."""
    kinds = np.frombuffer(bytearray(data).translate(classes[:256].tobytes()), np.uint8)
    high = np.flatnonzero(data >= 0x80)
    if not len(high):
        return kinds, None
    inner = (data & 0xC0) == 0x80
    lead = high[data[high] >= 0xC0]
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    first = padded[lead]
    more = [padded[lead + i] & 0x3F for i in (1, 2, 3)]
    two = (first & 0x1F) << 6 | more[0]
    three = (first & 0x0F) << 12 | more[0] << 6 | more[1]
    four = (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    code = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    kind = classes[np.minimum(code, 0x10FFFF)]
    kinds[high] = OTHER
    kinds[lead] = kind
    for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        longer = first >= least
        at = lead[longer] + i
        inside = at < len(data)
        kinds[at[inside]] = kind[longer][inside]
    return kinds, inner


def cuts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 texts that lie one after the other.

    Runs of letters, of numbers and of all else are pieces, each with a space
    right before it; white space before that is a piece of its own, and so are
    the endings after an apostrophe that opens a run.
    """
    n = len(data)
    kinds, inner = byte_classes(data, classes)
    blank = kinds == BLANK
    white = kinds >= SPACE
    np.minimum(kinds, SPACE, out=kinds)
    start = np.ones(n + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start |= edge
    # the last character of white space that something follows: a space goes with that, any other is a piece
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & start[1:n] & ~edge[1:n]
    taken = np.zeros(n + 1, bool)
    taken[1:] = last & blank
    if inner is not None:
        for i in np.flatnonzero(last & inner):
            last[i] = False
            while inner[i]:
                i -= 1
            last[i] = True
    marks = np.flatnonzero(data == 0x27)
    marks = marks[start[marks] & ~taken[marks]]
    start[:-1] |= last
    start &= ~taken
    for at in marks.tolist():
        end = int(offsets[np.searchsorted(offsets, at, "right")])
        after = data[at + 1 : min(at + 3, end)].tobytes()
        for ending in ENDINGS:
            if after.startswith(ending):
                start[at + 1] = False
                to = at + 1 + len(ending)
                if to < end and kinds[to] == LETTER:
                    start[to] = True
                break
    return np.flatnonzero(start[:-1])


def roomy(held: np.ndarray, n: int, need: int) -> np.ndarray:
    """An array that starts with n values of held and has room for so many."""
    if need <= len(held):
        return held
    out = np.zeros(2 * need, held.dtype)
    out[:n] = held[:n]
    return out


class Encoder:
    """Encodes texts by the tokenizers library, each distinct piece of text once.

    Merging never crosses the pieces that a byte-level tokenizer cuts first, so
    the ids of a text are those of its pieces.  Pieces of up to SHORT bytes are
    looked up as two numbers that hold all their bytes and their length; longer
    ones by their bytes.  With a tokenizer file of another kind, and for texts
    that hold one of its special tokens or a zero byte, the library encodes
    whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = loaded(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = self.tokenizer.get_vocab_size()
        parts = json.loads(self.tokenizer.to_str())
        cutter = parts["pre_tokenizer"] or {}
        self.by_piece = parts["normalizer"] is None and parts["post_processor"] is None and parts["truncation"] is None and parts["padding"] is None and all(
            cutter.get(k) == v
            for k, v in BYTE_LEVEL.items()
        ) and not parts["model"].get("dropout")
        self.letters = byte_letters()
        self.classes = character_classes()
        self.forget()

    def forget(self) -> None:
        """Empties the cache: a table of the short pieces' own numbers and 1, their two numbers, the long pieces, the ids,
        a piece's first id and number of ids (in one number), and which pieces have been met again.

        All arrays but the table have room for more than the known pieces and their ids.
        """
        self.table = np.zeros(1 << TABLE_BITS, np.int32)
        self.low, self.high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.long: dict[bytes, int] = {}
        self.ids, self.spans = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.again, self.bytes, self.known, self.held = np.zeros(0, bool), 0, 0, 0

    def forget_rare(self) -> None:
        """Leaves the pieces that have been met again."""
        long, again = self.long, self.again[: self.known]
        keep = np.flatnonzero(again)
        if 2 * len(keep) > CACHED:
            return self.forget()
        (ids, counts), renamed = self.ids_of(keep), np.cumsum(again) - 1
        short = np.flatnonzero(roomy(self.high, len(self.high), self.known)[keep])
        low, high = self.low[keep[short]], self.high[keep[short]]
        kept = {piece: int(renamed[i]) for piece, i in long.items() if again[i]}
        self.forget()
        self.add(ids, counts)
        self.long, self.bytes = kept, sum(map(len, kept))
        self.insert(low, high, short)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Takes in the ids of pieces, numbered from the end of what is known."""
        known, held = self.known + len(counts), self.held + len(ids)
        self.ids = roomy(self.ids, self.held, held)
        self.spans, self.again = roomy(self.spans, self.known, known), roomy(self.again, self.known, known)
        self.ids[self.held : held] = ids
        self.spans[self.known : known] = self.held + np.cumsum(counts) - counts << 32 | counts
        self.again[self.known : known] = False
        self.known, self.held = known, held

    def ids_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces, one after the other, and how many each has."""
        spans = self.spans.take(pieces)
        counts = spans & 0xFFFFFFFF
        return self.ids.take(ragged(spans >> 32, counts)), counts

    def learn(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Encodes the pieces at these places, numbered from the end of what is known."""
        ends = np.cumsum(size + 1)
        chars = np.full(int(ends[-1]), FEED, "<u4")  # no byte is written as a line feed
        chars[ragged(ends - size - 1, size)] = self.letters[data[ragged(at, size)]]
        merge = self.tokenizer.model.tokenize
        ids, counts = [], []
        for piece in chars.tobytes().decode("utf-32-le").split("\n")[:-1]:
            tokens = merge(piece)
            counts.append(len(tokens))
            ids += [x.id for x in tokens]
        self.add(np.array(ids, np.int32), np.array(counts, np.int64))
        self.bytes += int(size.sum())

    def probe(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of short pieces; -1 for those that are not known."""
        slot = self.slot(low, high)
        found = self.table.take(slot).astype(np.int64) - 1
        left = np.flatnonzero(((self.low.take(found) != low) | (self.high.take(found) != high)) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << TABLE_BITS) - 1)
            found[left] = number = self.table.take(slot[left]).astype(np.int64) - 1
            left = left[((self.low.take(number) != low[left]) | (self.high.take(number) != high[left])) & (number >= 0)]
        return found

    @staticmethod
    def slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def insert(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Puts distinct short pieces into the table; of several that meet at a place the last gets it."""
        if not len(number):
            return
        need = int(number.max()) + 1
        self.low, self.high = roomy(self.low, len(self.low), need), roomy(self.high, len(self.high), need)
        self.low[number], self.high[number] = low, high
        slot, number = self.slot(low, high), number.astype(np.int32) + 1
        while len(slot):
            free = np.flatnonzero(self.table[slot] == 0)
            self.table[slot[free]] = number[free]
            lost = self.table[slot] != number
            slot, number = (slot[lost] + 1) & ((1 << TABLE_BITS) - 1), number[lost]

    def numbers(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece, encoding those that are new; 16 more bytes stand after the last."""
        eights = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
        keep = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1] * 8, np.uint64)
        length = np.minimum(size, SHORT)
        low = eights[at] & keep.take(length)
        high = eights[at + 8] & np.append(keep[:1].repeat(8), keep[:8]).take(length)
        high |= (np.arange(SHORT + 1, dtype=np.uint64) << np.uint64(56)).take(length)
        found = self.probe(low, high)
        long = np.flatnonzero(size > SHORT)
        found[long] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            self.again[np.delete(found, new)] = True
            new = new[size[new] <= SHORT]
        else:
            self.again[found] = True
        if len(new) or len(long):
            known = self.known
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            fresh = order[first].tolist()
            found[order] = known + np.cumsum(first) - 1
            self.insert(low[fresh], high[fresh], np.arange(known, known + len(fresh), dtype=np.int32))
            for i in long.tolist():
                piece = data[at[i] : at[i] + size[i]].tobytes()
                if piece not in self.long:
                    self.long[piece] = known + len(fresh)
                    fresh.append(i)
                elif self.long[piece] < known:
                    self.again[self.long[piece]] = True
                found[i] = self.long[piece]
            if fresh:
                self.learn(data, at[fresh], size[fresh])
        return found

    def whole(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        coded = [[*x.ids, end] for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in coded for i in x], np.int32), np.array([len(x) for x in coded], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other, each with the end id, and how many each has."""
        raw = data.tobytes()
        if not self.by_piece or b"\0" in raw or any(s in raw for s in self.specials):
            return self.whole(data, offsets, end)
        at = cuts(data, offsets, self.classes)
        size, padded = np.diff(at, append=len(data)), np.append(data, np.zeros(16, np.uint8))
        lengths, ids = [], []
        for low in range(0, len(at), PIECES):
            if self.known > CACHED or self.bytes > CACHED_BYTES:
                self.forget_rare()
            piece = self.numbers(padded, at[low : low + PIECES], size[low : low + PIECES])
            some, counts = self.ids_of(piece)
            ids.append(some)
            lengths.append(counts)
        sums = np.concatenate(([0], np.cumsum(np.concatenate(lengths or [at]), dtype=np.int64)))
        counts = np.diff(sums[np.searchsorted(at, offsets)]) + 1
        ends = np.cumsum(counts)
        out = np.full(int(ends[-1]) if len(ends) else 0, end, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = np.concatenate(ids or [at])
        return out, counts


def listed(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS, end: int = END_ID) -> DataFrame:
    """The blocks of docs (doc_id, text), in the columns of BLOCKS."""

    def run(batches):
        keep_freed()
        encoder, shard, number = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        held, lengths, names, total = [], [], [], 0

        def block():
            ids, counts = np.concatenate(held), np.concatenate(lengths)
            held.clear()
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": listed(pa.concat_arrays(names)),
                "lengths": listed(pa.array(counts, pa.int64())),
                "coded": pa.array([pack(ids, encoder.alphabet)], pa.binary()),
            })

        for batch in batches:
            for low, _, raw, rows in chunks(*buffers(batch.column(1)), TEXTS_BYTES):
                coded, counts = encoder.encode(raw, rows, end)
                ends = np.cumsum(counts)
                at, done = 0, 0
                while at < len(counts):
                    # as many whole documents as the block has room for, or one that is longer than a block
                    to = int(np.searchsorted(ends, done + block_ids - total, "right"))
                    to = max(to, at + (total == 0))
                    if to > at:
                        held.append(coded[done : ends[to - 1]])
                        lengths.append(counts[at:to])
                        names.append(batch.column(0).slice(low + at, to - at))
                        total += int(ends[to - 1]) - done
                        at, done = to, int(ends[to - 1])
                    if at < len(counts):
                        yield block()
                        number, held, lengths, names, total = number + 1, [], [], [], 0
        if names:
            yield block()
        held.clear()
        keep_freed(USUAL)
        give_back()

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ordered = plain.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(run, BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str, **settings) -> str:
    blocks(docs, tokenizer, **settings).write.parquet(path)
    return path


def starts(written: DataFrame) -> DataFrame:
    """shard, block, first: the number of ids in all blocks before, from two running sums."""
    counts = written.select("shard", "block", "n_ids")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard, that is per task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = counts.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
    return within.join(offsets, "shard").select("shard", "block", (F.col("own") + F.col("offset")).alias("first"))


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in a written dataset."""

    def run(batches):
        keep_freed()
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("coded")[i].as_py()).astype("<u4")
                counts = batch.column("lengths")[i].values
                lengths = counts.to_numpy()
                ends = np.cumsum(lengths)
                if len(lengths) and int(ends[-1]) != len(ids):
                    raise ValueError("a block's lengths don't match its ids")
                n, raw, cut = len(lengths), memoryview(ids).cast("B"), (4 * np.append(0, ends)).tolist()
                out = {
                    "shard": pa.array(np.full(n, batch.column("shard")[i].as_py(), np.int32)),
                    "block": pa.array(np.full(n, batch.column("block")[i].as_py(), np.int32)),
                    "inside": pa.array(ends - lengths),
                    "doc_id": batch.column("doc_ids")[i].values,
                    "n_tokens": counts,
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
        keep_freed(USUAL)
        give_back()

    written = spark.read.parquet(path)
    rows = written.mapInArrow(
        run,
        "shard int, block int, inside long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids,
    )
    placed = rows.join(starts(written), ["shard", "block"]).withColumn("start", F.col("first") + F.col("inside"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str | None = None, **settings) -> DataFrame:
    """Writes docs' ids to the shared folder and reads them back."""
    spark = docs.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    return read_ids(spark, write_ids(docs, path, tokenizer or byte_bpe_50k(), **settings))
