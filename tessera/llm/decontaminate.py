"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units after numbers and capitalised words become typed placeholders; all
else is lower-cased words.  Windows of WINDOW template words are hashed, and
documents' windows are joined to those of the benchmark.  Windows that match at
one offset between document and item belong to one occurrence; an occurrence
counts if it has at least LEAST windows (or all of the item's) and its slots are
consistent: each value that an item has in a slot stands for one value in the
document.  That catches questions whose numbers, names and units were exchanged,
and not prose of the same shape.

Each window has several readings, so that neither its place nor its case decides:
with all slots; with names as words; with all slots as words.  An item's capitals
that open a sentence may be names or not, so its windows are also read with those
alone as words; what stands for them need not be consistent.  A placeholder
depends on the word itself, not on what stands before it.

Windows with fewer than LITERAL words that are no placeholders say little and
count only where they are equal word for word (numbers too).  An occurrence
counts by its windows of enough words, or by all its windows, those included.
Items shorter than a window are one window of their length; one with fewer than
LITERAL such words must stand in the document as a whole, word for word, however
short it is.

The benchmark's windows are broadcast if they take at most BROADCAST bytes,
which are summed up first; with more, both sides are shuffled by hash, and the
texts of documents that matched are joined again.  `clean` broadcasts the ids it
drops up to the same bound, so that whole texts stay in the tasks that read
them; with more, they are shuffled by doc_id.

Defined results: a null or empty text or item matches nothing; a null doc_id or
item_id is a value like any other; repeated rows of documents are one document,
repeated items one item.  Other columns are not read.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import settle, whole_row

WINDOW = 8
LEAST = 5
LITERAL = 5
BROADCAST = 32 << 20
ROW_BYTES = 200
ID_BYTES = 100

#: Units that may follow a number.
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|oz|ml|l|km/h|mph|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|met(?:er|re)s?|lit(?:er|re)s?|grams?|kilograms?|dollars?|euros?|cents?|percent|degrees?|%|°C|°F"
# Private-use characters mark slots, so that no text holds them by itself.
NUMBER, UNIT, NAME, JOINT, OPEN = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
CLEAN = f"[{NUMBER}-{OPEN}]"


SEPARATOR = rf"[^\p{{L}}\p{{N}}{NUMBER}-{OPEN}]+"
PLAIN, TYPED, FULL = 0, 1, 2  # readings: no slots, numbers and units, names too


def marked(text: Column) -> Column:
    """Text in which a mark stands before the value of each slot."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), CLEAN, "")
    digits = F.regexp_replace(text, r"(?<=\d)[.,:](?=\d)", JOINT)
    digits = F.regexp_replace(
        digits,
        rf"(?<![\p{{L}}\p{{N}}])(\d[\d{JOINT}]*)[ \u00a0]?({UNITS})(?![\p{{L}}\p{{N}}])",
        f"{NUMBER}$1 {UNIT}$2",
    )
    digits = F.regexp_replace(digits, rf"(?<![\p{{L}}\p{{N}}{NUMBER}-{JOINT}])(\d[\d{JOINT}]*)(?![\p{{L}}\p{{N}}{JOINT}])", f"{NUMBER}$1")
    text = F.when(text.rlike(r"\d"), digits).otherwise(text)
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}{NUMBER}-{JOINT}])(\p{{Lu}}\p{{Ll}})", f"{NAME}$1")


def inner(words: Column) -> Column:
    """Without the empty words that a separator at either end makes."""
    words = F.when(F.get(words, F.lit(0)) == "", F.slice(words, F.lit(2), F.size(words) - 1)).otherwise(words)
    return F.when(F.get(words, F.size(words) - 1) == "", F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)


def bare(text: Column) -> Column:
    """A marked text in which marks alone stand for slots."""
    return F.regexp_replace(text, rf"([{NUMBER}-{NAME}])[\p{{L}}\p{{N}}{JOINT}]+", "$1")


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """rows with words (lower-cased, no marks) and the shapes full and typed; the same as words where there are no such slots."""
    rows = rows.withColumn("marked", F.lower(marked(F.col(text)))).drop(text)
    no_name = F.regexp_replace("marked", NAME, "")
    # each is split in one step and trimmed in the next, so that no text is split twice
    rows = rows.withColumn("words", F.split(F.regexp_replace("marked", f"[{NUMBER}-{NAME}]", ""), SEPARATOR))
    rows = rows.withColumn("typed", F.when(F.col("marked").rlike(f"[{NUMBER}-{UNIT}]"), F.split(bare(no_name), SEPARATOR)))
    rows = rows.withColumn("full", F.when(F.col("marked").contains(NAME), F.split(bare(F.col("marked")), SEPARATOR)))
    rows = rows.drop("marked").withColumn("typed", F.coalesce("typed", "words")).withColumn("full", F.coalesce("full", "typed"))
    return rows.select(
        *[c for c in rows.columns if c not in ("words", "typed", "full")],
        *[inner(F.col(c)).alias(c) for c in ("words", "typed", "full")],
    )


def is_slot(word: Column) -> Column:
    return (word >= NUMBER) & (word < JOINT)


def places(shape: Column, window: int) -> Column:
    """The places (from 1) at which a window of template words starts."""
    return F.when(F.size(shape) >= window, F.sequence(F.lit(1), F.size(shape) - (window - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int, literal: int) -> DataFrame:
    """item_id, item_part, place, item_shape, reading, hash, length, n_strong, n_windows; an item shorter than a window is one window.

    item_part holds words, those of slots with their marks.
    """
    plain = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    # capitals that open a sentence may be names or not: a mark of their own
    text = F.lower(F.regexp_replace(marked(F.col("text")), rf"(?<![\p{{L}}\p{{N}},;:)]\s){NAME}", OPEN))
    texts = plain.select("item_id", text.alias("text"))
    no_open, no_name = F.regexp_replace("text", OPEN, ""), F.regexp_replace("text", f"[{NAME}{OPEN}]", "")
    no_mark = F.regexp_replace("text", f"[{NUMBER}-{NAME}{OPEN}]", "")
    as_name = F.regexp_replace("text", OPEN, NAME)
    readings = [(FULL, F.col("text"), as_name), (FULL, no_open, no_open), (TYPED, no_name, no_name), (PLAIN, no_mark, no_mark)]
    each = F.array(
        *[
            F.struct(F.lit(i).alias("priority"), F.lit(kind).alias("reading"), words.alias("words"), shape.alias("shape"))
            for i, (kind, words, shape) in enumerate(readings)
        ],
    )
    shaped = texts.select("item_id", F.explode(each).alias("r")).select("item_id", "r.*")
    shaped = shaped.withColumn("words", F.split("words", SEPARATOR)).withColumn("shape", F.split(bare(F.col("shape")), SEPARATOR))
    shaped = settle(shaped.withColumn("words", inner(F.col("words"))).withColumn("shape", inner(F.col("shape"))))
    at = F.when(F.size("shape") < window, F.array(F.lit(1))).otherwise(places(F.col("shape"), window))
    placed = shaped.filter(F.size("shape") > 0).select(
        "item_id",
        "priority",
        "reading",
        "words",
        "shape",
        F.explode(at).alias("place"),
    ).withColumn("part", F.slice("shape", F.col("place"), window))
    own = F.size(F.filter("part", lambda x: ~is_slot(x)))
    placed = placed.withColumn("own", own)
    # a window counts as one of enough words if it does so with all names as slots
    strong = F.max((F.col("priority") == 1) & (F.col("own") >= literal))
    named = placed.groupBy(F.col("item_id").alias("of"), F.col("place").alias("at")).agg(strong.alias("strong"))
    kept = placed.filter((F.col("own") >= literal) | (F.col("reading") == PLAIN))
    kept = kept.select(
        "item_id",
        F.slice("words", F.col("place"), window).alias("item_part"),
        "place",
        F.col("part").alias("item_shape"),
        "reading",
        F.xxhash64("part").alias("hash"),
        F.size("part").alias("length"),
    )
    kept = kept.groupBy("item_id", "place", "item_shape", "hash", "length").agg(
        F.min_by(F.struct("reading", "item_part"), F.col("reading")).alias("r"),
    ).select("item_id", "place", "item_shape", "hash", "length", "r.*")
    kept = kept.join(named, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at"))).drop("of", "at")
    totals = named.groupBy("of").agg(F.count_if("strong").alias("n_strong"), F.count("*").alias("n_windows"))
    return kept.join(totals, F.col("item_id").eqNullSafe(F.col("of"))).drop("of")


def matches(docs: DataFrame, items: DataFrame, window: int, small: bool) -> DataFrame:
    """doc_id, rid, at, doc_part and the columns of item_windows for each pair of equal windows.

    Only places are exploded: the words ride along unmoved inside one stage, and
    are cut to the window where a hash has matched.
    """
    rows = with_words(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text"), "text")
    lengths = [window, *sorted(r["length"] for r in items.filter(F.col("length") < window).select("length").distinct().collect())]
    out = None
    for length in lengths:
        asked = items.filter(F.col("length") == length)
        spread = rows.select("doc_id", "rid", "words", "typed", "full", F.explode(places(F.col("words"), length)).alias("at"))
        keyed = spread.select("*", *[F.xxhash64(F.slice(c, F.col("at"), length)).alias(f"{c}_hash") for c in ("words", "typed", "full")])
        one, two, three = F.col("words_hash"), F.col("typed_hash"), F.col("full_hash")
        hashes = F.when(
            (one == two) & (two == three),
            F.array(one),
        ).when(one == two, F.array(one, three)).when(two == three, F.array(one, two)).otherwise(F.array(one, two, three))
        hashed = keyed.withColumn("hash", F.explode(hashes)).drop("words_hash", "typed_hash", "full_hash")
        if small:
            met = hashed.join(F.broadcast(asked), "hash")
        else:
            met = hashed.select("rid", "at", "hash").distinct().join(asked, "hash").join(rows.dropDuplicates(["rid"]), "rid")
        # equal hashes, so compare the windows; as an equality this would become a part of the join's key
        read = F.when(F.col("reading") == PLAIN, F.col("words")).when(F.col("reading") == TYPED, F.col("typed")).otherwise(F.col("full"))
        own = F.slice(read, F.col("at"), length)
        met = met.filter((own >= F.col("item_shape")) & (own <= F.col("item_shape")))
        met = met.select(
            "doc_id",
            "rid",
            "at",
            F.slice("words", F.col("at"), length).alias("doc_part"),
            "item_id",
            "item_part",
            "place",
            "strong",
            "n_strong",
            "n_windows",
        )
        out = met if out is None else out.unionByName(met)
    return out


def leaks(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    least: int = LEAST,
    literal: int = LITERAL,
    most: int = BROADCAST,
) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, n_slots, n_changed of each document with an item in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = settle(item_windows(items, window, literal))
    held = F.length(F.concat_ws(" ", "item_part")) + F.length(F.concat_ws(" ", "item_shape"))
    small = (asked.agg(F.sum(4 * held + ROW_BYTES)).first()[0] or 0) <= most
    met = matches(docs, asked, window, small)
    slots = F.filter(F.arrays_zip(F.col("item_part").alias("i"), F.col("doc_part").alias("d")), lambda x: is_slot(x["i"]))
    pairs = F.transform(slots, lambda x: F.struct(x["i"].alias("i"), F.concat(F.substring(x["i"], 1, 1), x["d"]).alias("d")))
    grouped = met.select(
        "doc_id",
        "rid",
        "item_id",
        (F.col("at") - F.col("place")).alias("offset"),
        "place",
        "strong",
        "n_strong",
        "n_windows",
        pairs.alias("pairs"),
    ).groupBy("doc_id", "rid", "item_id", "offset")
    found = grouped.agg(
        F.size(F.collect_set(F.when(F.col("strong"), F.col("place")))).alias("strong"),
        F.max("n_strong").alias("n_strong"),
        F.size(F.collect_set("place")).alias("n_matched"),
        F.max("n_windows").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    values = F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"])))
    changed = F.size(F.filter("pairs", lambda x: x["i"] != x["d"]))
    by_strong = (F.col("n_strong") > 0) & (F.col("strong") >= F.least(F.lit(least), F.col("n_strong")))
    good = found.filter((by_strong | (F.col("n_matched") >= F.least(F.lit(least), F.col("n_windows")))) & (values == F.size("pairs")))
    good = good.withColumn("n_matched", F.when(by_strong, F.col("strong")).otherwise(F.col("n_matched"))).withColumn(
        "n_windows",
        F.when(by_strong, F.col("n_strong")).otherwise(F.col("n_windows")),
    )
    best = good.select(
        "doc_id",
        "item_id",
        F.struct("n_matched", F.col("n_windows"), F.size("pairs").alias("n_slots"), changed.alias("n_changed")).alias("b"),
    ).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.n_matched").alias("n_matched"),
        F.col("b.n_windows").alias("n_windows"),
        (F.col("b.n_matched") / F.col("b.n_windows")).alias("coverage"),
        F.col("b.n_slots").cast("long").alias("n_slots"),
        F.col("b.n_changed").cast("long").alias("n_changed"),
    )


def clean(docs: DataFrame, items: DataFrame, most: int = BROADCAST, **settings) -> DataFrame:
    """docs without the documents that hold an item; a null doc_id matches a null doc_id."""
    bad = settle(leaks(docs, items, most=most, **settings).select(F.col("doc_id").alias("leaking")).distinct())
    small = bad.count() * ID_BYTES <= most
    own = docs.select(whole_row(docs).alias("row")).withColumn("id", F.col("row.doc_id").cast("long"))
    return own.join(F.broadcast(bad) if small else bad, F.col("id").eqNullSafe(F.col("leaking")), "left_anti").select("row.*")
