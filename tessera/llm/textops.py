"""Vectorised text handling over Arrow batches, shared by the operators.

Texts are handled as UTF-8 bytes.  A batch is cut into chunks of whole
documents, so working memory depends on the chunk size (or on the longest
single document), never on how many rows Arrow delivers at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
SEGMENT_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
STEP = np.uint64(0xD6E8FEB86659FD93)
SALT = np.uint64(0xA0761D6478BD642F)


def space_table() -> np.ndarray:
    """Bytes of words between white space (space, tab to carriage return)."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_table() -> np.ndarray:
    """Bytes of words of digits, ASCII letters and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()  # no copy of the texts
    starts = np.frombuffer(
        offsets,
        kind,
        len(column) + 1,
        column.offset * kind().itemsize,
    ).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Yields (first row, end row, bytes, offsets) of runs of whole rows of about limit bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and for each row the index of its first word."""
    mask = table[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    starts, ends = mask.copy(), mask
    starts[1:] &= ~mask[:-1] | fresh[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | fresh[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one running polynomial."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        low = begin[at]
        to = max(at + 1, int(np.searchsorted(end, low + SEGMENT_BYTES, "right")))
        part = data[low : end[to - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        back = powers(inverse(base), len(part) + 1)
        b, e = begin[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[e] - sums[b]) * back[b] + (e - b).astype(np.uint64) * SALT)
        at = to
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position that has so many after it; rows are not kept apart."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(STEP, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse(STEP), count))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    out = np.repeat(starts - (ends - counts), counts)
    out += np.arange(len(out))
    return out


def squeezed(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row joined by one space, as bytes and row offsets."""
    rows = len(first) - 1
    counts = np.diff(first)
    sizes = end - begin + 1
    last = first[1:][counts > 0] - 1
    sizes[last] -= 1
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    out = np.full(int(places[-1]), 0x20, np.uint8)
    lengths = end - begin
    out[ragged(places[:-1], lengths)] = data[ragged(begin, lengths)]
    offsets = places[first] if len(begin) else np.zeros(rows + 1, np.int64)
    return out, offsets
