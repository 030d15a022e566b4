"""Chat formatting by quotation linking, in DataFrame operations only.

Each message's lines are parsed for nested quote marks.  Lines of one level that
follow each other form a passage.  Quoted passages, and their lines for quotes
of a part, are normalised and hashed and joined to the first message of the
conversation that has the passage or line unquoted; the original of most of a
message's outermost quoted passages and lines is its parent (on ties the
latest).  A message without such a quote answers the turn before it.  Roots and
depths follow by pointer doubling, and so does the place of each message in
reply order: every message stands after the one it answers, before what follows
that, and answers to one message stand in the order of turns.

Content is normalised to lower case with single spaces, and a passage's lines
are joined by one, so that a quote may be wrapped anew.  Attribution lines
("On ... wrote:" and the like) belong to no body.  Originals are summed up to one
row per conversation and hash before the join, so neither a frequent line nor a
large conversation is expanded into pairs, and no conversation is gathered in
one place.

Defined results: a null text has no lines and an empty body; a null
conversation or turn has no parent and is its own root; rows of equal
conversation and turn are one place in the thread, with the quotes of all of
them, and each keeps its row; a quote of no earlier message of its conversation
is dropped from the body and links nothing.  Other columns are not read.  An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ordering import following
from tessera.llm.storage import settle

MARKS = r"^[ \t]*((>[ \t]?)*)"
#: Fixed value: how mail programs introduce quotes, in four languages.
ATTRIBUTION = r"^(On|Le|Am|El) .* (wrote|écrit|schrieb|escribió) ?:[ \t\r]*$"


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash of each line with content, and of each passage of several."""
    own = messages.select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), "text")
    line = own.select("conv_id", "turn", "message", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), r"[ \t]", ""))
    content = F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", MARKS, "")), r"[ \t\r]+", " "))
    parsed = line.select(
        "conv_id",
        "turn",
        "message",
        "pos",
        level.alias("level"),
        content.alias("content"),
        F.col("line").rlike(ATTRIBUTION).alias("said"),
    )
    used = parsed.filter((F.col("content") != "") & ~F.col("said"))
    # places less ranks are equal for lines that follow each other
    rank = F.row_number().over(Window.partitionBy("message", "level").orderBy("pos"))
    runs = used.withColumn("run", F.col("pos") - rank).groupBy("conv_id", "turn", "message", "level", "run")
    joined = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("lines"))
    hashes = F.concat(
        F.transform("lines", lambda x: F.md5(x)),
        F.when(F.size("lines") > 1, F.array(F.md5(F.array_join("lines", " ")))).otherwise(F.array().cast("array<string>")),
    )
    return joined.select("conv_id", "turn", "level", F.explode(hashes).alias("hash"))


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, quoted_from (whether a quote says so), one row per place."""
    known = messages.filter("conv_id is not null and turn is not null")
    parsed = passages(known)
    originals = parsed.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quotes = parsed.filter("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.count("*").alias("n"))
    met = quotes.join(originals, ["conv_id", "hash"]).filter("original < turn")
    votes = met.groupBy("conv_id", "turn", "level", "original").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "original")).alias("best"))
    places = known.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    before = places.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    joined = places.join(best, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id",
        "turn",
        F.coalesce("best.original", "previous").alias("parent_turn"),
        F.col("best").isNotNull().alias("by_quote"),
    )


def roots(links: DataFrame) -> DataFrame:
    """links with root_turn and depth: each round doubles how far the places that are not at their root yet can see."""
    start = links.select(
        "*",
        F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("long").alias("depth"),
    )
    state = settle(start.withColumn("there", F.col("parent_turn").isNull()))
    while not (far := state.filter("not there")).isEmpty():
        seen = state.select(
            "conv_id",
            F.col("turn").alias("root_turn"),
            F.col("root_turn").alias("next"),
            F.col("depth").alias("more"),
            F.col("there").alias("ends"),
        )
        ahead = far.drop("there").join(seen, ["conv_id", "root_turn"])
        moved = ahead.select(
            *links.columns,
            F.col("next").alias("root_turn"),
            (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("there"),
        )
        state = settle(state.filter("there").unionByName(moved))
    return state.drop("there")


def reply_order(links: DataFrame) -> DataFrame:
    """conv_id, turn, position: the place of each turn in its conversation, from 0, when answers stand under what they answer."""
    ordered = following(links.select("conv_id", "parent_turn", "turn"), ["conv_id", "parent_turn", "turn"])
    same = (F.col("next.conv_id") == F.col("conv_id")) & F.col("next.parent_turn").eqNullSafe(F.col("parent_turn"))
    siblings = ordered.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.when(same, F.col("next.turn")).alias("after"))
    # after a turn and all under it: its next sibling, or what comes after its parent
    state = settle(siblings.withColumn("there", F.col("after").isNotNull() | F.col("up").isNull()))
    while not (far := state.filter("not there")).isEmpty():
        seen = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("after").alias("then"), F.col("there").alias("ends"))
        moved = far.select("conv_id", "turn", "up").join(seen, ["conv_id", "up"])
        moved = moved.select("conv_id", "turn", F.col("higher").alias("up"), F.col("then").alias("after"), F.col("ends").alias("there"))
        state = settle(state.filter("there").unionByName(moved))
    first = links.filter("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    steps = state.join(first, ["conv_id", "turn"], "left").select("conv_id", F.coalesce("child", "after").alias("turn"), F.col("turn").alias("parent_turn"))
    chain = links.select("conv_id", "turn").join(steps.filter("turn is not null"), ["conv_id", "turn"], "left")
    return roots(chain).select("conv_id", "turn", F.col("depth").alias("position"))


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quoted, quote_depth, parent_turn, by_quote, root_turn, depth, position, formatted for each message.

    In order of (conv_id, position) answers stand under what they answer; rows of one place have one position.
    """
    plain = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    links = settle(parents(plain))
    linked = roots(links).join(reply_order(links), ["conv_id", "turn"]).withColumnsRenamed({"conv_id": "c", "turn": "t"})
    every = F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[ \t]", ""))
    own = F.filter(every, lambda x: (level(x) == 0) & ~x.rlike(ATTRIBUTION))
    levels = F.transform(every, level)
    body = F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")
    quoted = F.size(F.filter(levels, lambda x: x > 0))
    parsed = plain.select(
        "conv_id",
        "turn",
        "role",
        body.alias("body"),
        quoted.cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(levels), F.lit(0)).cast("long").alias("quote_depth"),
    )
    joined = parsed.join(linked, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select(
        "conv_id", "turn", "role", "body", "n_quoted", "quote_depth", "parent_turn", F.coalesce("by_quote", F.lit(False)).alias("by_quote"),
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body")).alias("formatted"),
    )
