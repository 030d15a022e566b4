"""An adaptive context-mixing range coder for token ids, over many lanes at once.

A block of ids is cut into lanes of consecutive ids that are coded side by
side, each by a range coder of its own, with one model for all.  The model
counts which ids have followed the two ids before (order 2), the one id before
(order 1) and which occur at all (order 0), and learns at the ends of segments,
which grow with the block.  The three distributions share the code space:
order 2 has a share that depends on how often contexts of the same confidence
(how many observations, how many different ones) have held the id that came,
order 1 the same share of what is left, and order 0 the rest.  Lower orders
count only ids that the higher ones did not hold, so that they describe what
is left to them.

All arithmetic is on integers (quotients of those below 2^52 are cut from floating
point, which is exact), so that the decoder repeats the encoder's steps exactly.  Blocks share nothing: model and coder start anew in each, and each
names the ids that it uses and has a checksum of all its ids.

A block is: MAGIC; the number of ids, their CRC-32, the size of the alphabet,
the length of the next field and the number of words (32-bit little-endian); a
bitmap of the ids in use (zlib); a bitmap of the last 4 words a lane that are
not 0; the words but for those that are 0 there: the lanes' first two, then one
for each time that a lane moves on, in the order of steps and lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TCM3"
HEAD = 24
TOTAL_BITS = 28
ORDER0_BITS = 20
LANES = 4096
STEPS = 256
TAIL = 4
PART = 1 << 20
#: So many ids fit in a block: three numbers of this size go into one of the decoder's rows.
MOST = (1 << 21) - 1
PAD = 16
SLICE = 1 << 15
SLOT_BITS = 17
WEIGHT0 = 4
KINDS = 5
WORD = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)
SPACE = 1 << TOTAL_BITS
LIMIT = SPACE - (SPACE >> 4)
#: The first level of a number of observations: two classes for each doubling.
CLASS = KINDS * np.concatenate([[0], 1 + np.floor(2 * np.log2(np.arange(1, 4096)) + 1e-9).astype(np.int64)])
#: Before anything is learned: how many of 64 ids are held by contexts of each kind, from few different ids to all different.
PRIOR = np.tile(np.array([60, 54, 47, 37, 32], np.int64), int(CLASS[-1]) // KINDS + 1)


def differs(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys are not the same as the one before."""
    out = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=out[1:])
    return out


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b for numbers from 0 to 2^52, b not 0."""
    return (a / b).astype(np.int64)


def levels(size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The level of confidence of contexts by their observations and how many different ones."""
    level = CLASS[np.minimum(size, len(CLASS) - 1)]
    for j in (3, 2, 1):
        level += (kinds << j) > size
    level += kinds >= size
    return level


class Shares:
    """How much of the code space contexts of each level get, from how often they have held the id that came."""

    def __init__(self):
        self.seen = np.zeros((len(PRIOR), 2), np.int64)  # not held, held
        self.learn(np.zeros(0, np.int64), np.zeros(0, bool))

    def learn(self, level: np.ndarray, hit: np.ndarray) -> None:
        self.seen += np.bincount(level << 1 | hit, minlength=2 * len(PRIOR)).reshape(-1, 2)
        self.share = LIMIT * (64 * self.seen[:, 1] + 4 * PRIOR) // (64 * self.seen.sum(axis=1) + 256)
        self.share[:KINDS] = 0  # nothing observed

    def rates(self, level: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What one observation has of the code space in contexts of so many, in parts of SPACE."""
        return quotient(self.share[level], np.maximum(size, 1))


class Rest:
    """Order 0: the ids that no context held."""

    def __init__(self, alphabet: int):
        self.counts = np.zeros(alphabet, np.int64)
        self.learn(np.zeros(0, np.int64))

    def learn(self, ids: np.ndarray) -> None:
        self.counts += np.bincount(ids, minlength=len(self.counts))
        weights = 1 + WEIGHT0 * self.counts
        while (total := int(weights.sum())) > 1 << ORDER0_BITS:
            weights = (weights + 1) >> 1
        self.edges = np.zeros(len(weights) + 1, np.int64)
        np.cumsum(weights, out=self.edges[1:])
        self.edges = (self.edges << ORDER0_BITS) // total

    def places(self) -> np.ndarray:
        """The id at each place of this order's space."""
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), np.diff(self.edges))


class Layout:
    """How contexts and ids are numbered in a block of n ids that uses so many different ones."""

    def __init__(self, alphabet: int, n: int):
        self.alphabet, self.bits = alphabet, max(1, (alphabet - 1).bit_length())
        width = 32 if self.bits <= 16 else 64
        self.kind = np.uint32 if width == 32 else np.uint64
        self.width = n.bit_length()
        self.slot_bits = min(SLOT_BITS, max(8, n.bit_length() - 2), width - self.bits)

    def slot(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The order-2 context of two ids, hashed."""
        x = (np.asarray(before, np.int64) * 0x2545F491 + last).view(np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x >>= np.uint64(64 - self.slot_bits)
        return x.view(np.int64)

    def key(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.asarray(context).astype(self.kind) << self.kind(self.bits) | np.asarray(ids).astype(self.kind)


def observed(keys: np.ndarray, layout: Layout, ends: list[int], shares: Shares):
    """`parts_observed`, with the first, short segments looked at in a block of their own."""
    early = sum(end <= len(keys) // 16 for end in ends)
    if early > 1:
        yield from parts_observed(keys[: ends[early - 1]], layout, ends[:early], 0, shares)
    yield from parts_observed(keys, layout, ends, early if early > 1 else 0, shares)


def parts_observed(keys: np.ndarray, layout: Layout, ends: list[int], done: int, shares: Shares):
    """Segment by segment (they end at ends) where its keys (context and id) stand, and of the keys in segments before:

    the level of each key's context, how many of the context have smaller ids,
    how many are the same key, how many are of the context, and the rate of the
    context by what shares has learned until the segment.  All from one sort; in a
    segment, keys come in their own order, SLICE at a time.
    """
    n = len(keys)
    if layout.kind is np.uint32:
        both = np.sort(keys.astype(np.uint64) << HALF | np.arange(n, dtype=np.uint64))
        time, keys = (both & WORD).view(np.int64), (both >> HALF).astype(np.uint32)
    else:
        time = np.argsort(keys, kind="stable")
        keys = keys[time]
    fresh = differs(keys)
    group = np.cumsum(fresh, dtype=np.int32) - 1
    heads = np.flatnonzero(fresh)
    opens = differs(keys[heads] >> layout.kind(layout.bits))
    of = np.cumsum(opens, dtype=np.int32) - 1  # the context of each group
    firsts = np.append(np.flatnonzero(opens), len(heads))
    segment = np.repeat(np.arange(len(ends), dtype=np.int8), np.diff(ends, prepend=0))[time]
    oldest, heads = segment[heads], np.append(heads, n)
    earlier, kinds = np.zeros(n + 1, np.int32), np.zeros(len(heads), np.int32)
    for j in range(max(done, 1), len(ends)):
        # how many of the segments before stand before each place; keys are in the order of time
        np.cumsum(segment < j, out=earlier[1:])
        np.cumsum(oldest < j, out=kinds[1:])
        smaller = earlier[heads]
        before = smaller[firsts]
        total = np.diff(before)
        level = levels(total, np.diff(kinds[firsts]))
        packed = total.astype(np.int64) << 36 | shares.rates(level, total) << 8 | level
        here = np.flatnonzero(segment == j)
        for i in range(0, len(here), SLICE):
            some = here[i : i + SLICE]
            mine = group[some].astype(np.int64)
            context = of[mine].astype(np.int64)
            less, all_of = smaller[mine], packed[context]
            yield time[some], all_of & 0xFF, less - before[context], earlier[some] - less, all_of >> 36, all_of >> 8 & (SPACE - 1)


class Order:
    """What has followed each context, for the decoder: a row for each observation, sorted by context and id.

    A row has the first observation of the same, how many there are, and the id.
    """

    def __init__(self, contexts: int, layout: Layout):
        self.layout, self.shares = layout, Shares()
        self.keys = np.zeros(0, layout.kind)
        self.sizes, self.level = np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)
        self.starts, self.packed = np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)
        self.rows = np.zeros(0, np.int64)

    def learn(self, context: np.ndarray, ids: np.ndarray, hit: np.ndarray) -> None:
        """Takes in a segment: contexts, the ids that came, and whether the contexts held them."""
        self.shares.learn(self.level[context], hit)
        self.sizes += np.bincount(context, minlength=len(self.sizes))
        self.keys = np.sort(np.concatenate([self.keys, self.layout.key(context, ids)]))
        heads = np.flatnonzero(differs(self.keys))
        different, times = self.keys[heads].astype(np.int64), np.diff(heads, append=len(self.keys))
        kinds = np.bincount(different >> self.layout.bits, minlength=len(self.sizes))
        self.level = levels(self.sizes, kinds)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # one number for each context, so that one look-up gives both
        self.packed = self.sizes << TOTAL_BITS | self.shares.rates(self.level, self.sizes)
        low = different & ((1 << self.layout.bits) - 1)
        self.rows = np.repeat((heads << self.layout.width | times) << self.layout.bits | low, times)

    def weigh(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context the number of observations and the rate of one."""
        packed = self.packed.take(context)
        return packed >> TOTAL_BITS, packed & (SPACE - 1)

    def at(self, context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids at these observations of contexts, how many have smaller ids and how many are the same."""
        start, layout = self.starts.take(context), self.layout
        row = self.rows.take(start + place)
        many = row >> layout.bits
        return row & ((1 << layout.bits) - 1), (many >> layout.width) - start, many & ((1 << layout.width) - 1)


def shape(n: int) -> tuple[int, int, int]:
    """(lanes, steps, lanes that are active in the last step) of a block of n ids."""
    lanes = max(1, min(LANES, n // STEPS))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def segments(steps: int):
    """(first step, end step) of the segments: fast growing at first, then as long as all before."""
    low = 0
    while low < steps:
        high = min(steps, max(low + 1, low * (4 if 16 * low <= steps else 2)))
        yield low, high
        low = high


def narrowed(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which lanes have a settled upper half; cuts intervals that are small but not settled."""
    settled = (low ^ (low + size)) <= WORD
    small = size <= WORD
    cut = np.flatnonzero(small > settled)
    size[cut] = (~low[cut] + np.uint64(1)) & WORD
    return np.flatnonzero(settled | small)


def intervals(ids: np.ndarray, last: np.ndarray, before: np.ndarray, alphabet: int, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The start and width of each id's part of the code space, for all ids of a block in the order of coding.

    Counts of the past come from sorting the whole block; only the shares are
    learned segment by segment, as the decoder learns them.
    """
    n, layout = len(ids), Layout(alphabet, len(ids))
    packed = np.zeros(n, np.int64)  # width, and start or what higher orders have used, all below SPACE
    shares = Shares()
    for at, level, first, many, size, unit in observed(layout.key(layout.slot(last, before), ids), layout, ends, shares):
        wide = many * unit
        hit = wide > 0
        packed[at] = wide << TOTAL_BITS | np.where(hit, first, size) * unit
        shares.learn(level, hit)
    width = (packed >> TOTAL_BITS).astype(np.int32)
    start = (packed & (SPACE - 1)).astype(np.int32)
    left = np.flatnonzero(width == 0)
    x, base = ids[left], start[left].astype(np.int64)
    part, wide = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    shares, ends = Shares(), np.searchsorted(left, ends).tolist()
    for at, level, first, many, size, rate in observed(layout.key(last[left], x), layout, ends, shares):
        used = base[at]
        unit = rate * (SPACE - used) >> TOTAL_BITS
        part[at], wide[at] = used + first * unit, many * unit
        base[at] = used + size * unit
        shares.learn(level, (many * unit) > 0)
    rest = Rest(alphabet)
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        at = np.flatnonzero(wide[a:b] == 0) + a
        y, space = x[at], SPACE - base[at]
        part[at] = rest.edges[y] * space >> ORDER0_BITS
        wide[at] = (rest.edges[y + 1] * space >> ORDER0_BITS) - part[at]
        part[at] += base[at]
        rest.learn(y)
    start[left], width[left] = part, wide
    return start, width


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """A block of ids (0 to alphabet - 1) as bytes."""
    ids = np.asarray(ids)
    n = len(ids)
    if n > MOST:
        raise ValueError(f"a block of coded ids holds at most {MOST}")
    check = zlib.crc32(ids.astype("<u4").tobytes())
    present = np.bincount(ids, minlength=alphabet) > 0
    used = zlib.compress(np.packbits(present).tobytes())
    if not n:
        return MAGIC + struct.pack("<IIIII", n, check, alphabet, len(used), 0) + used
    lanes, steps, tail = shape(n)
    ids = (np.cumsum(present, dtype=np.int32) - 1)[ids]
    grid = np.zeros((steps + 2, lanes), np.int32)  # two steps of nothing before the first
    grid[2:, :tail] = ids[: tail * steps].reshape(tail, steps).T
    grid[2:-1, tail:] = ids[tail * steps :].reshape(lanes - tail, steps - 1).T
    ends = [min(n, b * lanes) for _, b in segments(steps)]
    flat = [grid[i : i + steps].ravel()[:n] for i in (2, 1, 0)]
    start, width = intervals(*flat, int(present.sum()), ends)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    moved, out = [], []
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        unit = size[:m] >> np.uint64(TOTAL_BITS)
        low[:m] += unit * start[at : at + m].astype(np.uint64)
        size[:m] = unit * width[at : at + m].astype(np.uint64)
        ready = narrowed(low[:m], size[:m])
        moved.append(ready)
        out.append(low[ready] >> HALF)
        low[ready] = low.take(ready) << HALF
        size[ready] = size.take(ready) << HALF
    lane, word = np.concatenate(moved), np.concatenate(out)
    # a lane's words: those it moved out, the one that ends it, and none more; each is read two moves ahead
    counts = np.bincount(lane, minlength=lanes)
    begin = np.cumsum(counts + 2) - counts - 2
    order = np.argsort(lane.astype(np.int16), kind="stable")
    place = np.empty(len(lane), np.int64)
    place[order] = np.arange(len(lane)) + 2 * lane[order]
    words = np.zeros(len(lane) + 2 * lanes, np.uint32)
    words[place] = word
    words[begin + counts] = (low + WORD) >> HALF
    stream = np.concatenate([words[begin], words[begin + 1], words[place + 2]])
    full = np.ones(len(stream), bool)
    full[-TAIL * lanes :] = stream[-TAIL * lanes :] != 0
    head = MAGIC + struct.pack("<IIIII", n, check, alphabet, len(used), len(stream))
    return head + used + np.packbits(full[-TAIL * lanes :]).tobytes() + stream[full].astype("<u4").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if it is damaged."""
    if block[:4] != MAGIC or len(block) < HEAD:
        raise ValueError("not a block of coded ids")
    n, check, alphabet, length, count = struct.unpack("<IIIII", block[4:HEAD])
    if n > MOST:
        raise ValueError("a block of coded ids doesn't match its checksum")
    at = HEAD + length
    if len(block) < at:
        raise ValueError("a block of coded ids is cut off")
    try:
        names = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(block[HEAD:at]), np.uint8), count=alphabet))
    except (zlib.error, ValueError) as e:
        raise ValueError("a block of coded ids doesn't match its checksum") from e
    ids = np.zeros(n, np.int32)
    if n:
        lanes, steps, tail = shape(n)
        given, full = np.zeros(count, np.uint64), np.ones(count, bool)
        marked = min(TAIL * lanes, count)
        mask = np.frombuffer(block[at : at + (marked + 7) // 8], np.uint8)
        if len(mask) != (marked + 7) // 8:
            raise ValueError("a block of coded ids is cut off")
        full[count - marked :] = np.unpackbits(mask, count=marked)
        at += len(mask)
        if len(block) != at + 4 * int(full.sum()):
            raise ValueError("a block of coded ids is cut off")
        if count < 2 * lanes or not len(names):
            raise ValueError("a block of coded ids doesn't match its checksum")
        given[full] = np.frombuffer(block, "<u4", offset=at)
        # two steps of nothing before the first; rows of the length of a power of 2 would share few lines of a cache
        grid, order = np.zeros((steps + 2, lanes + PAD), np.int32), np.zeros((steps, lanes), np.uint8)
        layout = Layout(len(names), n)
        two, one, zero = Order(1 << layout.slot_bits, layout), Order(len(names), layout), Rest(len(names))
        low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        code, read = (given[:lanes] << HALF) | given[lanes : 2 * lanes], 2 * lanes
        last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        for first, end in segments(steps):
            places = zero.places()
            for step in range(first, end):
                m = lanes if step < steps - 1 else tail
                if m < lanes:
                    low, size, code, last, before = low[:m], size[:m], code[:m], last[:m], before[:m]
                slot = layout.slot(last, before)
                many, unit = two.weigh(slot)
                coder = size >> np.uint64(TOTAL_BITS)
                with np.errstate(divide="ignore"):  # only in damaged blocks
                    value = ((code - low) // coder).view(np.int64)
                used = many * unit
                held = value < used
                x, start, width = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int64)
                at = np.flatnonzero(held)
                if len(at):
                    unit = unit.take(at)
                    x[at], smaller, same = two.at(slot.take(at), quotient(value.take(at), unit))
                    start[at], width[at] = smaller * unit, same * unit
                    order[step, at] = 2
                left = np.flatnonzero(~held)
                base, context = used.take(left), last.take(left)
                rest, space = value.take(left) - base, SPACE - base
                many, unit = one.weigh(context)
                unit *= space
                unit >>= TOTAL_BITS
                used = many * unit
                held = rest < used
                at = np.flatnonzero(held)
                if len(at):
                    to, unit = left.take(at), unit.take(at)
                    x[to], smaller, same = one.at(context.take(at), quotient(rest.take(at), unit))
                    start[to], width[to] = base.take(at) + smaller * unit, same * unit
                    order[step, to] = 1
                at = np.flatnonzero(~held)
                to, used = left.take(at), used.take(at)
                space, rest, base = space.take(at) - used, rest.take(at) - used, base.take(at) + used
                # beyond the last place only in damaged blocks
                found = places.take(quotient((rest + 1 << ORDER0_BITS) - 1, space), mode="clip")
                x[to] = found
                begin = zero.edges[found] * space >> ORDER0_BITS
                start[to], width[to] = base + begin, (zero.edges[found + 1] * space >> ORDER0_BITS) - begin
                low += coder * start.view(np.uint64)
                np.multiply(coder, width.view(np.uint64), out=size)
                ready = narrowed(low, size)
                if read + len(ready) > count:
                    raise ValueError("a block of coded ids doesn't match its checksum")
                code[ready] = (code.take(ready) << HALF) | given[read : read + len(ready)]
                read += len(ready)
                low[ready] = low.take(ready) << HALF
                size[ready] = size.take(ready) << HALF
                grid[step + 2, :m] = x
                before, last = last, x
            if end < steps:  # nothing learns from the last segment
                x, last1, last2 = (grid[first + i : end + i, :lanes].ravel() for i in (2, 1, 0))
                by = order[first:end].ravel()
                two.learn(layout.slot(last1, last2), x, by == 2)
                left = np.flatnonzero(by != 2)
                x, by = x[left], by[left]
                one.learn(last1[left].astype(np.int64), x, by == 1)
                zero.learn(x[by == 0])
        ids = names.astype(np.int32)[np.concatenate([grid[2:, :tail].T.ravel(), grid[2:-1, tail:lanes].T.ravel()])]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block of coded ids doesn't match its checksum")
    return ids


def pack(ids: np.ndarray, alphabet: int, most: int = PART) -> bytes:
    """Any number of ids as blocks of at most so many, one after the other: their number, their lengths, the blocks."""
    parts = [encode(ids[i : i + most], alphabet) for i in range(0, max(len(ids), 1), most)]
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    """The ids of packed blocks; raises ValueError if they are damaged."""
    count = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
    if not count or len(data) < 4 * (count + 1):
        raise ValueError("not blocks of coded ids")
    at = np.cumsum([4 * (count + 1), *struct.unpack_from(f"<{count}I", data, 4)]).tolist()
    if at[-1] != len(data):
        raise ValueError("blocks of coded ids are cut off")
    return np.concatenate([decode(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
