"""License scans: short notices found with a bounded number of edits.

A notice of k allowed edits is cut into k + 1 seeds, of which at least one
must stand unchanged in any text within k edits (pigeonhole).  Exact searches
for seeds locate candidates; each candidate is compared exactly first and then
by the regex library's bounded-error matching, which gives its span and edits.

Texts are lower-cased (A-Z) and taken as words of digits, ASCII letters and
characters beyond ASCII, joined by single spaces; spans count words from 0.

Defined results: a null or empty text has no words and no hits; rows are
independent, so repeated rows and ties repeat their results; other columns are
not read.  Very long texts are handled whole.  An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.storage import small_batches
from tessera.llm.textops import alnum_table, buffers, chunks, lower_table, squeezed, words


class Notice(NamedTuple):
    phrase: str
    label: str
    edits: int = 0


#: The phrases and labels that are asked for, then others of our own.
BASE_NOTICES = (
    Notice("cc by", "cc-by"),
    Notice("general public license", "gpl", 2),
    Notice("all rights reserved", "reserved", 2),
)
MORE_NOTICES = (
    Notice("licensed under the apache license", "apache", 3),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("creative commons attribution", "creative-commons", 2),
    Notice("mozilla public license", "mpl", 2),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, hits array<struct<label: string, phrase: string, first_word: long, last_word: long, edits: int, text: string>>"
)


def seeds(notice: Notice) -> list[tuple[int, bytes]]:
    """edits + 1 pieces of the phrase and where each starts."""
    phrase, n = notice.phrase.encode(), notice.edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def found(text: bytes, piece: bytes):
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def pattern(notice: Notice):
    return regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice.phrase)}){{e<={notice.edits}}}(?![^ ])")


def search(text: bytes, offsets: np.ndarray, notice: Notice, fuzzy) -> list[tuple[int, int, int, int]]:
    """(row, start, end, edits) of each place of the notice in squeezed rows that lie one after the other."""
    phrase, k = notice.phrase.encode(), notice.edits
    hits, tried = set(), set()
    for shift, piece in seeds(notice):
        for at in found(text, piece):
            row = int(np.searchsorted(offsets, at, "right")) - 1
            low, high = int(offsets[row]), int(offsets[row + 1])
            start, end = at - shift, at - shift + len(phrase)
            if start >= low and end <= high and text[start:end] == phrase:
                if (start == low or text[start - 1] == 32) and (end == high or text[end] == 32):
                    hits.add((row, start, end, 0))
                    continue
            if not k or at + len(piece) > high or (row, start) in tried:
                continue
            tried.add((row, start))
            low, high = max(low, start - 4 * k - 1), min(high, end + 4 * k + 1)
            while low < high and text[low] & 0xC0 == 0x80:
                low += 1
            window = text[low:high].decode("utf-8", "ignore")
            if m := fuzzy.search(window):
                a = low + len(window[: m.start()].encode())
                b = low + len(window[: m.end()].encode())
                inside = (a == offsets[row] or text[a - 1] == 32) and (b == offsets[row + 1] or text[b] == 32)
                if inside:
                    hits.add((row, a, b, sum(m.fuzzy_counts)))
    exact = {(row, start) for row, start, _, edits in hits if not edits}
    ends = {(row, end) for row, _, end, edits in hits if not edits}
    return sorted(h for h in hits if not h[3] or ((h[0], h[1]) not in exact and (h[0], h[2]) not in ends))


def scan(docs: DataFrame, notices: tuple[Notice, ...] = MORE_NOTICES, base: tuple[Notice, ...] = BASE_NOTICES) -> DataFrame:
    """One row per document of docs (doc_id, text), in the columns of SCHEMA; one pass, no shuffle."""

    def run(batches):
        letters, lower = alnum_table(), lower_table()
        every = [(n, pattern(n), n in base) for n in (*base, *notices)]
        for batch in batches:
            ids = batch.column(0)
            data, offsets = buffers(batch.column(1))
            for low, high, raw, rows in chunks(data, offsets):
                raw = lower[raw]
                begin, end, first = words(raw, rows, letters)
                flat, places = squeezed(raw, begin, end, first)
                text = flat.tobytes()
                starts = np.flatnonzero(np.concatenate(([True], flat[:-1] == 32))) if len(flat) else begin
                starts = np.union1d(starts, places[:-1][np.diff(first) > 0]).astype(np.int64)
                hits: list[list] = [[] for _ in range(high - low)]
                kept: list[list] = [[] for _ in range(high - low)]
                best = [0.0] * (high - low)
                for notice, fuzzy, is_base in every:
                    for row, a, b, edits in search(text, places, notice, fuzzy):
                        w = int(np.searchsorted(starts, a, "right")) - 1 - int(first[row])
                        to = w + text.count(b" ", a, b)
                        hits[row].append(
                            {
                                "label": notice.label,
                                "phrase": notice.phrase,
                                "first_word": w,
                                "last_word": to,
                                "edits": edits,
                                "text": text[a:b].decode("utf-8", "replace"),
                            },
                        )
                        best[row] = max(best[row], 1 - edits / len(notice.phrase))
                        if is_base and not edits:
                            kept[row].append((w, notice.label))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(low, high - low),
                        "n_words": pa.array(np.diff(first)),
                        "n_base": pa.array([len(x) for x in kept], pa.int64()),
                        "first_word": pa.array([min(x)[0] if x else None for x in kept], pa.int64()),
                        "last_word": pa.array([max(x)[0] if x else None for x in kept], pa.int64()),
                        "base_labels": [",".join(sorted({y for _, y in x})) for x in kept],
                        "labels": [",".join(sorted({y["label"] for y in x})) for x in hits],
                        "score": best,
                        "hits": pa.array(
                            hits,
                            pa.list_(
                                pa.struct(
                                    [
                                        ("label", pa.string()),
                                        ("phrase", pa.string()),
                                        ("first_word", pa.int64()),
                                        ("last_word", pa.int64()),
                                        ("edits", pa.int32()),
                                        ("text", pa.string()),
                                    ],
                                ),
                            ),
                        ),
                    }
                )

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)
