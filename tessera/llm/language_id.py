"""Language ID by hierarchical discrimination.

Families of languages are told apart first; inside a family, each two
languages have a linear support vector machine of their own, and most votes
(then the larger sum of margins) decide.  Families too are told apart by
one-versus-one machines.  Features are hashed byte trigrams of the
lower-cased text, scaled to length one by square roots of frequencies.

Languages of unknown code join the family of the most similar texts where there
are more than the square root of all languages of them, so that the number of
machines grows with the power 1.5 of the languages and not with their square.

Every lang value is learned, however many there are.  Training uses at most
PER_LANGUAGE rows of each language, chosen by a hash of doc_id (a parameter);
each machine is fitted by a task of its own on the rows of its two sides.  The
driver holds a mean for each language and the machines, which go to the
executors once.  Prediction reads every whole text: the machines between
families first, then those of the family found.

Defined results: a text that is null or has no letter is `und` with score 0;
rows are independent; doc_id may be null or repeat; other columns are not
read.  With one language to learn, every text with letters gets it; with none,
every text is `und`.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import settle, small_batches
from tessera.llm.textops import buffers, lower_table

BITS = 13
PER_LANGUAGE = 1000
DENSE_ROWS = 256

#: Families of languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
}


def family(lang: str) -> str:
    return next((name for name, of in FAMILIES.items() if lang.lower().split("-")[0] in of), lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trigrams(raw: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The hashed trigram at each byte but the last two."""
    x = lower[raw].astype(np.uint32)
    return (
        (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    ).astype(np.int32)


def features(raw: np.ndarray, lower: np.ndarray) -> np.ndarray:
    if len(raw) < 3:
        raw = np.concatenate([raw, np.full(3 - len(raw), 32, np.uint8)])
    counts = np.sqrt(np.bincount(trigrams(raw, lower), minlength=1 << BITS).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def machine(plus: np.ndarray, minus: np.ndarray, rounds: int = 12, penalty: float = 1e-3) -> np.ndarray:
    """Weights (and a last one for the bias) of a linear machine with hinge loss, by averaged subgradient steps."""
    x = np.vstack([plus, minus])
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.concatenate([np.ones(len(plus)), -np.ones(len(minus))]).astype(np.float32)
    each = np.where(y > 0, 0.5 / max(len(plus), 1), 0.5 / max(len(minus), 1)).astype(np.float32)
    order = np.random.default_rng(1).permutation(len(x))
    x, y, each = x[order], y[order], each[order] * len(x)
    w, total, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0
    for _ in range(rounds):
        for a in range(0, len(x), 32):
            t += 1
            part, sign = x[a : a + 32], y[a : a + 32]
            wrong = (part @ w) * sign < 1
            rate = 1 / (penalty * (t + 50))
            w *= 1 - rate * penalty
            if wrong.any():
                w += rate * ((sign * each[a : a + 32] * wrong) @ part) / len(part)
            norm = float(np.linalg.norm(w))
            if norm > 1 / penalty**0.5:
                w *= 1 / (penalty**0.5 * norm)
            total += w
    return (total / max(t, 1)).astype(np.float32)


def dense(rows: list[bytes]) -> np.ndarray:
    """Feature vectors from their places and values, as `samples` writes them."""
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, x in enumerate(rows):
        pairs = np.frombuffer(x, np.dtype([("at", "<u2"), ("value", "<f2")]))
        out[i, pairs["at"]] = pairs["value"]
    return out


def samples(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, rank, x: at most per_language rows of each language that are not held out, in the order of a hash of doc_id."""
    rows = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count()
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a row for each language, fewer bytes than the machines that will be learned; some more rows than needed are picked, so that enough are
    share = F.broadcast(counts.select("lang", (F.lit(1.1 * (per_language + 30)) / F.col("count")).alias("share")))
    picked = rows.withColumn("u", u).join(share, "lang").filter("u < share").select("lang", "u", "text")

    def run(batches):
        lower = lower_table()
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for a in range(0, batch.num_rows, 500):
                b = min(batch.num_rows, a + 500)
                vectors = []
                for i in range(a, b):
                    full = features(data[offsets[i] : offsets[i + 1]], lower)
                    at = np.flatnonzero(full)
                    pairs = np.empty(len(at), np.dtype([("at", "<u2"), ("value", "<f2")]))
                    pairs["at"], pairs["value"] = at, full[at]
                    vectors.append(pairs.tobytes())
                yield pa.RecordBatch.from_pydict(
                    {"lang": batch.column(0).slice(a, b - a), "u": batch.column(1).slice(a, b - a), "x": vectors},
                )

    made = picked.mapInArrow(run, "lang string, u double, x binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "x")) - 1
    return made.withColumn("rank", rank).filter(F.col("rank") < per_language).select("lang", "rank", "x")


def families_of(means: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """The languages of each family; languages of unknown code are families, or join the most similar one if there are many."""
    out: dict[str, list[str]] = {}
    for x in sorted(means):
        out.setdefault(family(x), []).append(x)
    known = {f for f in FAMILIES if f in out}
    alone = [f for f in sorted(out) if f not in known]
    most = max(len(known), 8, math.ceil(math.sqrt(len(means))))
    if len(out) <= most:
        return out
    unit = {x: m / max(float(np.linalg.norm(m)), 1e-9) for x, m in means.items()}
    heads = {f: np.mean([unit[x] for x in out[f]], axis=0) for f in sorted(known)}
    nearest = {f: max((float(unit[f] @ h) for h in heads.values()), default=0.0) for f in alone}
    while len(heads) < most:  # the one least like all heads so far becomes a head
        f = min((f for f in alone if f not in heads), key=lambda f: (nearest[f], f))
        heads[f] = unit[f]
        nearest = {g: max(v, float(unit[g] @ unit[f])) for g, v in nearest.items()}
    for f in alone:
        if f not in heads:
            to = max(heads, key=lambda h: (float(unit[f] @ heads[h]), h))
            out[to].extend(out.pop(f))
    return {f: sorted(of) for f, of in sorted(out.items())}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The machines, from rows of docs (doc_id, text, lang) that are not held out."""
    spark = docs.sparkSession
    rows = settle(samples(docs, per_language))

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(dense(list(part["x"][i : i + DENSE_ROWS])).sum(axis=0) for i in range(0, len(part), DENSE_ROWS))
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "mean": [(total / len(part)).astype(np.float32).tobytes()]})

    found = rows.groupBy("lang").applyInPandas(mean, "lang string, mean binary").toPandas()
    means = {x: np.frombuffer(m, np.float32) for x, m in zip(found["lang"], found["mean"], strict=True)}
    langs, families = sorted(means), families_of(means)
    names = list(families)
    pairs, sides = [], []
    for f, g in combinations(names, 2):
        each = max(50, per_language // max(len(families[f]), len(families[g])))
        sides += [(len(pairs), sign, x, each) for sign, of in ((1, f), (-1, g)) for x in families[of]]
        pairs.append(("", names.index(f), names.index(g)))
    for f in names:
        for a, b in combinations(families[f], 2):
            sides += [(len(pairs), 1, a, per_language), (len(pairs), -1, b, per_language)]
            pairs.append((f, families[f].index(a), families[f].index(b)))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["sign", "lang", "rank"])
        weights = machine(*(dense(list(part["x"][part["sign"] == sign])) for sign in (1, -1)))
        return pd.DataFrame({"pair": [part["pair"].iloc[0]], "weights": [weights.tobytes()]})

    model = {"langs": langs, "families": families, "pairs": {f: [] for f in ("", *names)}, "weights": {}}
    if pairs:
        asked = spark.createDataFrame(sides, "pair int, sign int, lang string, most int")
        fitted = rows.join(asked, "lang").filter("rank < most").groupBy("pair").applyInPandas(fit, "pair int, weights binary").toPandas()
        weights = {int(i): np.frombuffer(w, np.float32) for i, w in zip(fitted["pair"], fitted["weights"], strict=True)}
        for i, (f, a, b) in enumerate(pairs):
            model["pairs"][f].append((a, b))
            model["weights"].setdefault(f, []).append(weights[i])
    model["weights"] = {f: np.vstack(w) for f, w in model["weights"].items()}
    return model


def voted(x: np.ndarray, pairs: list[tuple[int, int]], weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n classes the one with most votes for each line of x (on ties the larger margins), and how sure its closest vote is."""
    if n == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    margins = (x @ weights[:, :-1].T + weights[:, -1]).astype(np.float64)
    sure = 1 / (1 + np.exp(-2 * np.clip(margins, -20, 20)))
    votes, least = np.zeros((len(x), n)), np.ones((len(x), n))
    for j, (a, b) in enumerate(pairs):
        m, p = margins[:, j], sure[:, j]
        votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
        votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
        least[:, a] = np.minimum(least[:, a], p)
        least[:, b] = np.minimum(least[:, b], 1 - p)
    best = votes.argmax(axis=1)
    return best, least[np.arange(len(x)), best]


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lower, letter, model = lower_table(), regex.compile(r"\p{L}"), sent.value
        names, families, pairs, weights = list(model["families"]), model["families"], model["pairs"], model["weights"]

        def guess(texts: list[np.ndarray]) -> tuple[list[str], list[float]]:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if len(t) and letter.search(t.tobytes().decode("utf-8", "replace"))]
            if not names or not lettered:
                return langs, scores
            x = np.vstack([features(texts[i], lower) for i in lettered])
            best, sure = voted(x, pairs[""], weights.get(""), len(names))
            for j in np.unique(best).tolist():
                of = families[names[j]]
                mine = np.flatnonzero(best == j)
                lang, own = voted(x[mine], pairs[names[j]], weights.get(names[j]), len(of))
                for k, at, p in zip(mine.tolist(), lang.tolist(), own.tolist(), strict=True):
                    langs[lettered[k]], scores[lettered[k]] = of[at], min(p, float(sure[k]))
            return langs, scores

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for low in range(0, batch.num_rows, DENSE_ROWS):
                high = min(batch.num_rows, low + DENSE_ROWS)
                langs, scores = guess([data[offsets[i] : offsets[i + 1]] for i in range(low, high)])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(low, high - low), "lang_pred": langs, "score": scores})

    return docs.selectExpr(
        "cast(doc_id as long) as doc_id",
        "cast(text as string) as text",
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on docs that are not held out, for every row of docs."""
    small_batches(docs.sparkSession)
    return predict(docs, train(docs, **bounds)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
