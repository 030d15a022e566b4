"""MinHash near-dedup with odd sketches.

Each document's set of word shingles gives MinHash samples; bands of samples
put similar documents into common buckets, and the samples folded into a parity
bitmap (an odd sketch) tell from the number of ones in the XOR of two bitmaps
how many samples differ, which rejects candidates that can't be similar.  The
rest are confirmed on full sets.  Bands are chosen so that a pair at the
threshold is missed with a probability of at most MISS.

No bucket is expanded into all its pairs.  Documents of equal sets are one
class from the start.  Members are compared with a few pivots of their bucket;
classes that become linked need no further comparison.  What buckets that still hold several
components connect is compared in blocks, where pairs of different components
that share a band and pass the sketch are confirmed; there no such pair is left
out, so no link between components is lost.

Classes, links and components are told apart by row numbers of the signatures'
table, never by doc_id, so that a null or repeated doc_id joins nothing.

Defined results: a null or empty text has an empty set, is a component of its
own and is kept.  A component is named by its smallest doc_id, null if it has
none; kept says that a row has that doc_id, and stays that it is the one row of
the component to keep (of several rows with that doc_id, the first).  A doc_id
with several texts has a row for each, in the component of that text.  Other
columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import stars
from tessera.llm.storage import give_back, settle, small_batches, whole_row
from tessera.llm.textops import buffers, chunks, gram_hashes, lower_table, mix, space_table, word_hashes, words

SAMPLES = 256
MISS = 1e-8
SKETCH_BITS = 512
BLOCK_GRAMS = 200_000
TURNS = 2
PIVOTS = 3
SMALL = 16


def banding(threshold: float, samples: int = SAMPLES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands that still miss a pair at the threshold with at most that probability."""
    for rows in range(16, 0, -1):
        if (1 - threshold**rows) ** (samples // rows) <= miss:
            return samples // rows, rows
    return samples, 1


def most_different(threshold: float, samples: int, bits: int) -> int:
    """The ones in the XOR of two sketches that a pair at the threshold stays below but once in 50 million times.

    Two sources of chance: how many samples differ, and how many of the
    differing elements (two a sample) fall on the same bits.
    """
    elements = 2 * samples * (1 - threshold)
    ones = bits / 2 * (1 - np.exp(-2 * elements / bits))
    sampled = 2 * np.sqrt(samples * (1 - threshold) * threshold) * np.exp(-2 * elements / bits)
    folded = np.sqrt(bits / 4 * (1 - np.exp(-4 * elements / bits)))
    return int(np.ceil(ones + 5.5 * np.hypot(sampled, folded)))


def shingles(raw: np.ndarray, rows: np.ndarray, n: int, table: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, and where each row's start."""
    raw = lower[raw]
    begin, end, first = words(raw, rows, table)
    hashes = word_hashes(raw, begin, end)
    grams = gram_hashes(hashes, n)
    parts, sizes = [], np.zeros(len(rows), np.int64)
    for i in range(len(rows) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            part = np.unique(grams[a : b - n + 1])
        elif b > a:
            part = mix(gram_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a))
        else:
            continue
        parts.append(part)
        sizes[i + 1] = len(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


def signatures(docs: DataFrame, n: int, bands: int, rows_per_band: int, bits: int) -> DataFrame:
    """rid (the row's number), doc_id, text_hash, n_shingles, digest (of the set), bands and sketch of each row of docs (doc_id, text_hash, text)."""
    samples = bands * rows_per_band

    def run(batches):
        table, lower = space_table(), lower_table()
        rng = np.random.default_rng(20)
        scale, shift = rng.integers(
            0,
            1 << 31,
            samples,
            np.uint32,
        ) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, samples, np.uint32)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for low, high, raw, rows in chunks(data, offsets):
                grams, starts = shingles(raw, rows, n, table, lower)
                counts = np.diff(starts)
                full = np.flatnonzero(counts)
                digests, keys, sketches = [None] * (high - low), [None] * (high - low), [None] * (high - low)
                if len(full):
                    at = starts[:-1][full]
                    one, two = np.add.reduceat(mix(grams + np.uint64(1)), at), np.add.reduceat(
                        mix(grams ^ np.uint64(0x5851F42D4C957F2D)),
                        at,
                    )
                    x = (grams >> np.uint64(32)).astype(np.uint32)
                    least = np.empty((len(full), samples), np.uint32)
                    for j in range(samples):
                        least[:, j] = np.minimum.reduceat(x * scale[j] + shift[j], at)
                    key = np.zeros((len(full), bands), np.uint64)
                    for r in range(rows_per_band):
                        key = mix(key + least[:, r::rows_per_band].astype(np.uint64) + np.uint64(r + 1))
                    place = mix(least.astype(np.uint64) + (np.arange(samples, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
                    odd = np.zeros((len(full), bits), np.uint8)
                    np.add.at(odd, (np.arange(len(full))[:, None], place.astype(np.int64)), 1)
                    sketch = np.packbits(odd & 1, axis=1)
                    for j, i in enumerate(full):
                        digests[i] = one[j].tobytes() + two[j].tobytes()
                        keys[i] = key[j].view(np.int64)
                        sketches[i] = sketch[j].tobytes()
                columns = {
                    "doc_id": batch.column(0).slice(low, high - low),
                    "text_hash": batch.column(1).slice(low, high - low),
                    "n_shingles": pa.array(counts),
                    "digest": pa.array(digests, pa.binary()),
                    "bands": pa.array(keys, pa.list_(pa.int64())),
                    "sketch": pa.array(sketches, pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    made = docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary")
    return made.withColumn("rid", F.monotonically_increasing_id())


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """id, grams: the full shingle set of each row of docs (id, text)."""

    def run(batches):
        table, lower = space_table(), lower_table()
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for low, high, raw, rows in chunks(data, offsets):
                grams, starts = shingles(raw, rows, n, table, lower)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["id", "grams"])
        give_back()

    return docs.mapInArrow(run, "id long, grams array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("of_a"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    close = common * 100 >= F.lit(round(threshold * 100)) * (F.size("of_a") + F.size("of_b") - common)
    return pairs.join(one, "a").join(two, "b").filter(close).select("a", "b")


def likely(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in at most that many bits."""
    one = sketches.select(F.col("id").alias("a"), F.col("words").alias("of_a"))
    two = sketches.select(F.col("id").alias("b"), F.col("words").alias("of_b"))
    ones = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(one, "a").join(two, "b").filter(ones <= most).select("a", "b")


def sketch_words(sketch, bits: int):
    return F.array(*[F.conv(F.hex(F.substring(sketch, 1 + 4 * i, 4)), 16, 10).cast("long") for i in range(bits // 32)])


def within_clusters(
    open_buckets: DataFrame,
    labels: DataFrame,
    sketches: DataFrame,
    sets: DataFrame,
    most: int,
    threshold: float,
) -> DataFrame:
    """The links (a, b) that are left between components, from buckets (bucket, id) that hold several.

    Documents that such buckets connect form a cluster, whose members are dealt
    to blocks of about BLOCK_GRAMS shingles.  Each two blocks of a cluster, and
    each block alone, are a task of their own, to which their members go with
    their sets: pairs of different components that share a band and pass the
    sketch are confirmed on full sets, unless links found before have joined
    them already; only links that join components are returned.
    """
    least = open_buckets.groupBy("bucket").agg(F.min("id").alias("b"))
    clusters = stars(open_buckets.join(least, "bucket").filter("id <> b").select(F.col("id").alias("a"), "b").distinct())
    rows = clusters.withColumnRenamed("component", "cluster").join(labels, "id").join(
        sketches.select("id", "sketch", "bands"),
        "id",
    ).join(sets, "id")
    rows = settle(rows)
    # where members go is worked out without their sets, so that no task gets a cluster as a whole
    sizes = rows.groupBy("cluster").agg(F.ceil(F.sum(F.size("grams")) / BLOCK_GRAMS).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = rows.select("id", "cluster").join(sizes, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    other = dealt.select("id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sides = other.select("id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    member = F.struct((F.col("block") == F.col("low")).alias("first"), "id", "component", "sketch", "bands", "grams")
    lists = rows.join(sides, "id").groupBy("cluster", "low", "high").agg(F.collect_list(member).alias("members"))
    part = round(threshold * 100)

    def run(batches):
        def read(part):
            sketch = np.vstack([np.frombuffer(x, np.uint8) for x in part.field("sketch").to_pylist()]).view(np.uint64)
            grams = part.field("grams")
            at, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)  # sorted as unsigned
            every = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            return part.field("id").to_numpy(), part.field("component").to_numpy(), sketch, np.array(
                part.field("bands").to_pylist(),
                np.int64,
            ), every

        for batch in batches:
            links = []
            for i in range(batch.num_rows):
                members, same = batch.column(0)[i].values, batch.column(1)[i].as_py()
                first = members.field("first")
                a, ca, sa, ba, ga = read(members.filter(first))
                if same:
                    b, cb, sb, bb, gb = a, ca, sa, ba, ga
                elif len(a) == len(members) or not len(a):
                    continue
                else:
                    b, cb, sb, bb, gb = read(members.filter(pc.invert(first)))
                root = {int(c): int(c) for c in (*ca, *cb)}

                def find(c):
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                for low in range(0, len(a), 256):
                    high = low + 256
                    ones = sum(np.bitwise_count(sa[low:high, None, j] ^ sb[None, :, j]).astype(np.int16) for j in range(sa.shape[1]))
                    able = (ones <= most) & (ca[low:high, None] != cb[None, :])
                    if same:
                        able &= a[low:high, None] > b[None, :]
                    x, y = np.nonzero(able)
                    order = np.argsort(ones[x, y], kind="stable")
                    x, y = x[order] + low, y[order]
                    for at in range(0, len(x), 20_000):
                        meet = (ba[x[at : at + 20_000]] == bb[y[at : at + 20_000]]).any(axis=1)
                        for p, q in zip(x[at : at + 20_000][meet].tolist(), y[at : at + 20_000][meet].tolist(), strict=True):
                            one, two = find(int(ca[p])), find(int(cb[q]))
                            if one == two:
                                continue
                            few, many = sorted((ga[p], gb[q]), key=len)
                            if 100 * len(few) < part * len(many):
                                continue
                            common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                            if 100 * common >= part * (len(few) + len(many) - common):
                                root[max(one, two)] = min(one, two)
                                links.append((int(a[p]), int(b[q])))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())},
            )
        give_back()

    return lists.select("members", F.expr("low = high").alias("same")).mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, signed: DataFrame, threshold: float, n: int, bands: int, rows_per_band: int, bits: int) -> DataFrame:
    """id, component for the class representatives that have links."""
    most = most_different(threshold, bands * rows_per_band, bits)
    members = signed.filter("digest is not null")
    classes = members.groupBy("digest").agg(
        F.min_by(F.struct("bands", "sketch", "doc_id", "text_hash"), "rid").alias("s"),
        F.min("rid").alias("id"),
    )
    per_band = classes.select("id", F.posexplode("s.bands").alias("band", "key")).select(
        "id",
        "band",
        F.xxhash64("band", "key").alias("bucket"),
    )
    shared = per_band.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    buckets = settle(per_band.join(shared, "bucket"))
    asked = buckets.select("id").distinct()
    sketches = settle(
        classes.join(asked, "id", "left_semi").select("id", "s.sketch", "s.bands", sketch_words(F.col("s.sketch"), bits).alias("words")),
    )
    # the texts of classes that share a bucket are read again: sets of all others would be written in vain
    wanted = classes.join(asked, "id", "left_semi").select("id", F.col("s.doc_id").alias("named"), F.col("s.text_hash").alias("hashed"))
    texts = docs.join(
        wanted,
        F.col("doc_id").eqNullSafe(F.col("named")) & F.col("text_hash").eqNullSafe(F.col("hashed")),
    ).select("id", "text")
    sets = settle(sets_of(texts, n).groupBy("id").agg(F.first("grams").alias("grams")))

    # first each class with its smallest pivot alone, which resolves most buckets; then with some of each open bucket
    least = buckets.groupBy("bucket").agg(F.min("id").alias("pivot"))
    pairs = buckets.join(least, "bucket").groupBy("id").agg(F.min("pivot").alias("pivot")).filter("pivot < id").select(
        F.col("id").alias("a"),
        F.col("pivot").alias("b"),
    )
    edges = None
    for turn in range(TURNS):
        new = settle(confirmed(likely(pairs, sketches, most), sets, threshold))
        labels = settle(
            sketches.select("id").join(
                stars(new if edges is None else edges.unionByName(new)),
                "id",
                "left",
            ).select("id", F.coalesce("component", "id").alias("component")),
        )
        edges = labels.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        named = buckets.join(labels, "id")
        open_ = named.groupBy("bucket").agg(
            F.count_distinct("component").alias("parts"),
            F.count("*").alias("size"),
        ).filter("parts > 1").select("bucket", "size")
        if turn == TURNS - 1:
            break
        # the small ones are left to the blocks
        large = named.join(open_.filter(F.col("size") > SMALL), "bucket")
        chosen = large.groupBy("bucket").agg(
            F.array_distinct(
                F.array(*[F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(j))) for j in range(PIVOTS)]),
            ).alias("pivots"),
        )
        met = large.join(chosen, "bucket").select(
            "id",
            "component",
            F.explode("pivots").alias("pivot"),
        ).filter("component <> pivot.component")
        pairs = met.select(F.greatest("id", "pivot.id").alias("a"), F.least("id", "pivot.id").alias("b")).distinct()
    rest = within_clusters(named.join(open_, "bucket").select("bucket", "id"), labels, sketches, sets, most, threshold)
    return stars(edges.unionByName(rest))


def components(docs: DataFrame, threshold: float = 0.8, n: int = 5, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept, stays."""
    bands, rows_per_band = banding(threshold)
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    small_batches(docs.sparkSession)
    signed = settle(signatures(plain, n, bands, rows_per_band, bits))
    links = settle(linked(plain, signed, threshold, n, bands, rows_per_band, bits))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    classes = signed.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("id"), best.alias("best"))
    named = classes.join(links, "id", "left")
    # only components of several classes are summed up and sent back
    several = named.filter("component is not null")
    whole = several.groupBy("component").agg(F.min("best").alias("whole"))
    found = named.join(whole, "component", "left").select("digest", F.coalesce("whole", "best").alias("best"))
    joined = signed.select("rid", "doc_id", "text_hash", "n_shingles", "digest").join(found, "digest", "left")
    alone = F.col("digest").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    stays = alone | (F.col("rid") == F.col("best.rid"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, stays).alias("kept"),
        stays.alias("stays"),
    )


def near_dedup(docs: DataFrame, threshold: float = 0.8, n: int = 5, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, stays."""
    return components(docs, threshold, n, bits).drop("text_hash")


def without_copies(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """docs with one row of each component, whatever its columns are called."""
    found = components(docs, threshold, n)
    counts = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.count_if("stays").alias("staying"))
    marks = settle(counts.filter("staying < rows").select(F.col("doc_id").alias("named"), F.col("text_hash").alias("hashed"), "staying"))
    own = docs.select(whole_row(docs).alias("row"))
    keyed = own.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("named")) & F.col("hash").eqNullSafe(F.col("hashed"))
    others = keyed.join(marks, same, "left_anti").select("row.*")
    repeated = keyed.join(
        marks.filter("staying = 1"),
        same,
        "left_semi",
    ).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")
    return others.union(repeated)
