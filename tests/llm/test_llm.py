"""Each operator against a brute-force version, on the supplied tables and on odd rows."""

import functools
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import queries as Q
from tessera.llm.components import stars
from tessera.llm.decontaminate import clean, leaks
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import identify
from tessera.llm.license_scan import scan
from tessera.llm.mixture import mix, rates
from tessera.llm.near_dedup import banding, near_dedup, without_copies
from tessera.llm.quality import level_of_top, resample, scored
from tessera.llm.quote_threads import threads
from tessera.llm.range_coder import decode, encode
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.token_output import Encoder, blocks, byte_bpe_50k, round_trip

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "one"),
        (5, long),
        (6, long + " end"),
        (7, "a b c d"),
        (7, "a b c d"),
        (None, "a b c d"),
        (None, None),
        (8, "é" * 50),
        (9, "CC BY cc  by\nCC-BY"),
        (10, "<|endoftext|> hi"),
        (11, "x " * 500),
        (12, "!!! ..."),
    ]
    return spark.createDataFrame([(i, t, "en", None, 1, "clash") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# 1 -------------------------------------------------------------------------
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_hits(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    hits = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, hits


def check_scan(df, expected):
    got = df.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in expected)
    texts = defaultdict(list)
    for i, t in expected:
        texts[i].append(t)
    for r in got:
        assert any(
            (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
                len(w),
                len(h),
                min(h)[0] if h else None,
                max(h)[0] if h else None,
                ",".join(sorted({x for _, x in h})),
            )
            for w, h in map(base_hits, texts[r["doc_id"]])
        )
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_scan_base(docs, rows):
    check_scan(scan(docs), rows)


def test_scan_odd(odd, none):
    check_scan(scan(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert scan(none).count() == 0


def test_scan_edits(spark):
    texts = [
        "Code. All rigths reserved, 2020",
        "all right reserved",
        "the genral public licence here",
        "Licensed under the Apach License",
        "general purpose",
        "é all rights réserved",
        "all rights reserved all rights reservd",
    ]
    got = by_id(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["labels"] for i in range(7)] == ["reserved", "reserved", "gpl", "apache", "", "reserved", "reserved"]
    assert [(h["first_word"], h["last_word"], h["text"]) for h in got[0]["hits"]] == [(1, 3, "all rigths reserved")]
    assert [got[i]["n_base"] for i in range(7)] == [0, 0, 0, 0, 0, 0, 1] and len(got[6]["hits"]) == 2
    assert got[1]["score"] < 1 and got[4]["score"] == 0


def test_scan_brute(spark, rows):
    """Labels against the bounded-error search of whole texts, on random edits of all notices."""
    from tessera.llm.license_scan import BASE_NOTICES, MORE_NOTICES, pattern

    rng = np.random.default_rng(1)
    notices, texts = (*BASE_NOTICES, *MORE_NOTICES), [t for _, t in rows[:60]]
    for k in range(400):
        phrase = list(notices[k % len(notices)].phrase)
        for _ in range(rng.integers(0, 6)):
            at, what = rng.integers(0, len(phrase)), rng.integers(0, 3)
            phrase[at : at + (what > 0)] = [] if what == 1 else [rng.choice(list("abcde "))]
        texts.append(f"{'some words ' * (k % 3)}{''.join(phrase)}{' and more' * (k % 2)}")
    got = by_id(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    searches = [(n.label, pattern(n)) for n in notices]
    for i, t in enumerate(texts):
        flat = " ".join(base_hits(t)[0])
        assert set(filter(None, got[i]["labels"].split(","))) == {label for label, p in searches if p.search(flat)}, t


# 2 -------------------------------------------------------------------------
def check_exact(df, expected, pick):
    groups = defaultdict(list)
    for i, t in expected:
        groups[t or ""].append(i)
    kept = Counter()
    digests = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    got = df.collect()
    assert len(got) == len(expected)
    for r in got:
        ids = groups[digests[r["text_sha256"]]]
        named = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (pick(named) if named else None) and r["doc_id"] in ids
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_exact(docs, rows, odd, none):
    check_exact(exact_dedup(docs, keep="largest"), rows, max)
    check_exact(exact_dedup(odd), [(r["doc_id"], r["text"]) for r in odd.collect()], min)
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("least", [1, 3, 64, 10_000])
def test_exact_hot(spark, docs, rows, least):
    """Groups of any size, split or not, some of null or repeated identifiers; texts that differ after a long common opening."""
    head = "the same opening of many texts " * 20
    some = [(i % 400, "hot") for i in range(900)] + [(None, "hot")] * 3 + [(None, "nameless")] * 200 + [
        (i, None if i % 2 else "")
        for i in range(300)
    ] + [(i, f"{head}{i % 7}") for i in range(500)] + [(5, "once")]
    for keep, pick in (("largest", max), ("smallest", min)):
        check_exact(exact_dedup(spark.createDataFrame(some, "doc_id long, text string"), keep=keep, least=least), some, pick)
    check_exact(exact_dedup(docs, least=least), rows, min)


def test_exact_compares_contents(spark):
    """Groups are made of neighbours in the sort, and of hot runs by their contents; no digest is a grouping key, and splitters are short."""
    from tessera.llm.exact_dedup import runs

    df = spark.createDataFrame([(i, "x" * 10_000) for i in range(500)], "doc_id long, text string")
    plan = runs(df, df.text, "largest")._jdf.queryExecution().executedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line)
    assert "content" in window and "sha2" not in plan.split("Window", 1)[1] and "rangepartitioning(prefix" in plan and plan.count("rangepartitioning") == 1


# 3 -------------------------------------------------------------------------
def brute_cut(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1024, 1])
def test_substrings(docs, rows, group):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(docs, group=group).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_cut([t for _, t in rows], 35), strict=True))


def test_substrings_small(spark, odd, none):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(80)]
    for group in (1024, 2):
        got = substring_dedup(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
            window=9,
            prefix=3,
            group=group,
        ).collect()
        assert sorted(
            (r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
            for r in got
        ) == [(i, *x) for i, x in enumerate(brute_cut(texts, 9))]
    expected = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(odd).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(expected, brute_cut([t for _, t in expected], 35), strict=True))
    assert substring_dedup(none).count() == 0


# 4 -------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000, 70_001])
def test_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.minimum(rng.zipf(1.3, n), 50256), np.full(n, 50256), np.arange(n) % 50257):
        block = encode(ids, 50257)
        assert (decode(block) == ids).all()
    assert len(encode(np.zeros(n, np.int64), 50257)) < 200 + n


def test_coder_damage():
    block = bytearray(encode(np.arange(3000) % 97, 50257))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode(bytes(block))
    with pytest.raises(ValueError, match="cut off"):
        decode(bytes(block[:-4]))
    with pytest.raises(ValueError, match="not a block"):
        decode(b"abcd")


def test_coder_damage_anywhere():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 20_000), 50256)
    block = encode(ids, 50257)
    for at in rng.integers(0, len(block), 300).tolist():
        damaged = bytearray(block)
        damaged[at] ^= 1 << int(rng.integers(8))
        try:  # damage to a bit that says nothing changes no id
            assert (decode(bytes(damaged)) == ids).all()
        except ValueError:
            pass
    with pytest.raises(ValueError, match="at most"):
        encode(np.zeros(1 << 21, np.int32), 2)


def test_coder_learns_only_what_is_used(monkeypatch):
    """The decoder sorts no observations after the last segment, which is half of a block."""
    from tessera.llm import range_coder

    learned, learn = [], range_coder.Order.learn
    monkeypatch.setattr(range_coder.Order, "learn", lambda self, context, *more: (learned.append(len(context)), learn(self, context, *more)))
    n = 1 << 17
    ids = np.minimum(np.random.default_rng(5).zipf(1.3, n), 50256)
    assert (decode(encode(ids, 50257)) == ids).all()
    assert learned and sum(learned) <= n


def test_quotients_are_exact():
    from tessera.llm.range_coder import quotient

    rng = np.random.default_rng(6)
    for bits in (1, 20, 28):
        b = rng.integers(1, 1 << bits, 20_000, endpoint=True)
        for a in (rng.integers(0, 1 << 48, 20_000), rng.integers(0, (1 << 48) // b) * b, rng.integers(1, (1 << 48) // b) * b - 1):
            assert (quotient(a, b) == a // b).all()


def check_ids(df, expected):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_50k())
    ids = [[*x.ids, 0] for x in tokenizer.encode_batch([t or "" for _, t in expected], add_special_tokens=False)]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(expected, ids, strict=True))
    got = df.orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_token_output(docs, rows, odd, none, spark):
    check_ids(round_trip(docs, block_ids=5000), rows)
    check_ids(round_trip(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert blocks(none, byte_bpe_50k()).count() == 0
    assert round_trip(none).count() == 0


def test_pieces_are_those_of_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = Encoder(byte_bpe_50k())

    def check(texts):
        raw = [t.encode() for t in texts]
        ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [[*x.ids, 0] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(), max_size=4))
    def same(texts):
        check(texts)

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.text("ab Zé\u00a0\u2003\n\t'strelvmd1\u0663.,!\u6f22\U0001f600", max_size=30), max_size=4))
    def same_edges(texts):
        check(texts)

    same()
    same_edges()
    check(["it's we'll I'd 'tis don't''s x'S 's's  'm\n're", " 's", "'", "l'l", "l'll'll"])
    check(["a" * 15 + " " + "a" * 16 + " " + "b" * 100, "a\0b", "<|endoftext|> x"])


def test_pieces_are_encoded_once(monkeypatch):
    """Half a million different pieces stay known; beyond the bound those met again do."""
    from tessera.llm import token_output

    def new(encoder, numbers):
        before, learned = Encoder.learn, []
        monkeypatch.setattr(Encoder, "learn", lambda self, data, at, size: (learned.append(len(at)), before(self, data, at, size)))
        for low in range(0, len(numbers), 50_000):
            raw = "".join(f" {i}" for i in numbers[low : low + 50_000]).encode()
            encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        monkeypatch.setattr(Encoder, "learn", before)
        return sum(learned)

    encoder = Encoder(byte_bpe_50k())
    assert new(encoder, range(500_000)) == 500_000
    assert new(encoder, range(500_000)) == 0
    monkeypatch.setattr(token_output, "CACHED", 1000)
    encoder = Encoder(byte_bpe_50k())
    assert new(encoder, range(300)) == 300 and new(encoder, range(2000)) == 1700
    assert new(encoder, range(300)) == 0 and encoder.known == 300
    raw = b" 7 1999 299 12345678901234567890"
    want = [*encoder.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, 0]
    assert encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == want


def test_other_tokenizers_encode_whole_texts():
    encoder = Encoder(byte_bpe_50k().replace("byte_bpe_50k", "word_bpe_49k"))
    raw = "Hello World  it's".encode()
    ids, counts = encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert not encoder.by_piece and ids.tolist() == [*encoder.tokenizer.encode("Hello World  it's", add_special_tokens=False).ids, 0]


def test_coder_parts():
    from tessera.llm.range_coder import pack, unpack

    ids = np.random.default_rng(0).integers(0, 500, 10_001)
    for n in (0, 1, 999, 1000, 1001, 10_001):
        assert (unpack(pack(ids[:n], 500, 1000)) == ids[:n]).all()
    for damaged in (b"", b"abcd", pack(ids, 500, 1000)[:-4]):
        with pytest.raises(ValueError, match="blocks of coded ids"):
            unpack(damaged)


def test_coder_learns(docs):
    """Counted orders 1 and 2 take far less than the entropy of order 0."""
    encoder = Encoder(byte_bpe_50k())
    texts = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    ids, _ = encoder.encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert 8 * len(encode(ids, encoder.alphabet)) < 0.9 * len(ids) * -(p * np.log2(p)).sum()


# 5 -------------------------------------------------------------------------
TALK = [
    (1, 0, "ann", "Hello all\nWhat is a monad?\n"),
    (1, 1, "bob", "> What is a  MONAD?\nA monoid."),
    (1, 2, "cat", "Something else"),
    (1, 3, "dan", "On Monday bob wrote:\n> A monoid.\n> > What is a monad?\nThanks"),
    (1, 4, "eve", ">> what is a monad?\nMe too"),
    (1, 5, "fay", "> never said\nok"),
    (2, 0, "ann", "> What is a monad?"),
    (2, 2, "bob", None),
    (2, 2, "bob", "again"),
    (None, 1, "x", "> a\nb"),
    (3, None, "x", ""),
    (4, 1, None, "hi\r\n> quoted\r"),
]


def test_threads(spark):
    got = threads(spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(TALK)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [(one[i]["parent_turn"], one[i]["by_quote"], one[i]["root_turn"], one[i]["depth"]) for i in range(6)] == [
        (None, False, 0, 0),
        (0, True, 0, 1),
        (1, False, 0, 2),
        (1, True, 0, 2),
        (0, True, 0, 1),
        (4, False, 0, 2),
    ]
    assert [one[i]["body"] for i in range(6)] == ["Hello all\nWhat is a monad?", "A monoid.", "Something else", "Thanks", "Me too", "ok"]
    assert [one[i]["quote_depth"] for i in range(6)] == [0, 1, 0, 2, 2, 1] and one[3]["n_quoted"] == 2
    assert one[1]["formatted"] == "<|bob|>\nA monoid."
    two = [r for r in got if r["conv_id"] == 2]
    assert all(r["parent_turn"] is None and r["depth"] == 0 for r in two) and {r["body"] for r in two if r["turn"] == 2} == {"", "again"}
    assert [r["body"] for r in got if r["conv_id"] is None] == ["b"] and [r["body"] for r in got if r["conv_id"] == 4] == ["hi"]


def test_reply_order(spark):
    """Places in a tree walk, for trees of any shape, against recursion."""
    from tessera.llm.quote_threads import reply_order

    rng = np.random.default_rng(9)
    shapes = [[None, *[rng.integers(0, i) for i in range(1, 60)]], [None, *range(49)], [None, *[0] * 40], [None if i % 3 == 0 else i - 1 for i in range(30)], [None]]
    rows = [(c, 10 * i, None if p is None else 10 * int(p), False) for c, shape in enumerate(shapes) for i, p in enumerate(shape)]
    want = {}
    for c, shape in enumerate(shapes):
        under = defaultdict(list)
        for i, p in enumerate(shape):
            under[p].append(i)
        stack, place = under[None][::-1], 0
        while stack:
            i = stack.pop()
            want[c, 10 * i], place = place, place + 1
            stack += under[i][::-1]
    got = reply_order(spark.createDataFrame(rows, "conv_id long, turn long, parent_turn long, by_quote boolean")).collect()
    assert {(r["conv_id"], r["turn"]): r["position"] for r in got} == want and len(got) == len(rows)


def test_threads_passages(spark):
    """A quote that was wrapped anew is found as a passage, and a part of one by its lines."""
    talk = [
        (1, 0, "a", "The first paragraph goes\nover two lines.\n\nAnd another one\nfollows here."),
        (1, 1, "b", "Something else"),
        (1, 2, "c", "> The first\n> paragraph goes over\n> two lines.\nYes"),
        (1, 3, "d", "> follows here.\nNo"),
        (1, 4, "e", "> > And another one follows\n> > here.\n> No\nHm"),
        (1, 5, "f", "> The first paragraph\nnot whole"),
    ]
    got = {r["turn"]: r for r in threads(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[i]["parent_turn"], got[i]["by_quote"]) for i in range(6)] == [
        (None, False),
        (0, False),
        (0, True),
        (0, True),
        (3, True),
        (4, False),
    ]


def test_threads_chain(spark):
    chain = [(7, i, "r", f"> line {i - 1}\nline {i}") for i in range(100)]
    got = {r["turn"]: r for r in threads(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[i]["depth"] == i and got[i]["root_turn"] == 0 for i in range(100))
    assert threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 6 -------------------------------------------------------------------------
def test_leaks(docs, rows, spark, odd, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    squeeze = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    brute = {(i, b["item_id"]) for i, t in rows for b in items.collect() if f" {squeeze(b['text'])} " in f" {squeeze(t)} "}
    found = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    assert brute and brute <= found
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items, most=0).collect()} == found
    assert clean(docs, items).count() == len(rows) - len({i for i, _ in found})
    assert leaks(odd, items).count() == 0 and leaks(none, items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert clean(odd, items).count() == odd.count()


def brute_leaks(texts, items, window=8, least=5, literal=5):
    """Every window of every document against every window of every item, in loops."""
    import regex

    from tessera.llm import decontaminate as D

    letters, marks = r"\p{L}\p{N}", f"{D.NUMBER}-{D.JOINT}"

    def marked(t):
        t = regex.sub(D.CLEAN, "", t or "")
        if regex.search("[0-9]", t):
            t = regex.sub("(?<=[0-9])[.,:](?=[0-9])", D.JOINT, t)
            t = regex.sub(rf"(?<![{letters}])([0-9][0-9{D.JOINT}]*)[ \u00a0]?({D.UNITS})(?![{letters}])", rf"{D.NUMBER}\1 {D.UNIT}\2", t)
            t = regex.sub(rf"(?<![{letters}{marks}])([0-9][0-9{D.JOINT}]*)(?![{letters}{D.JOINT}])", rf"{D.NUMBER}\1", t)
        return regex.sub(rf"(?<![{letters}{marks}])(\p{{Lu}}\p{{Ll}})", rf"{D.NAME}\1", t)

    bare = lambda t: regex.sub(rf"([{D.NUMBER}-{D.NAME}])[{letters}{D.JOINT}]+", r"\1", t)
    split = lambda t: [w for w in regex.split(D.SEPARATOR, t) if w]
    without = lambda t, chars: regex.sub(f"[{chars}]", "", t)
    slot = lambda w: D.NUMBER <= w[0] <= D.NAME
    found = set()
    asked = []
    for k, text in items:
        t = regex.sub(rf"(?<![{letters},;:)]\s){D.NAME}", D.OPEN, marked(text)).lower()
        plain = without(t, f"{D.NUMBER}-{D.NAME}{D.OPEN}")
        readings = [
            (2, t, t.replace(D.OPEN, D.NAME)),
            (2, without(t, D.OPEN), without(t, D.OPEN)),
            (1, without(t, D.NAME + D.OPEN), without(t, D.NAME + D.OPEN)),
            (0, plain, plain),
        ]
        strong, places, windows = set(), set(), {}
        for i, (kind, words, shape) in enumerate(readings):
            words, shape = split(words), split(bare(shape))
            for at in range(max(1, len(shape) - window + 1) if shape else 0):
                part = tuple(shape[at : at + window])
                own = sum(not slot(w) for w in part)
                places.add(at)
                if i == 1 and own >= literal:
                    strong.add(at)
                if (own >= literal or kind == 0) and kind <= windows.get((at, part), (9,))[0]:
                    windows.setdefault((at, part), (kind, words[at : at + window]))
                    if kind < windows[at, part][0]:
                        windows[at, part] = (kind, words[at : at + window])
        asked.append((k, strong, places, windows))
    for i, text in texts:
        m = marked(text).lower()
        words = split(without(m, f"{D.NUMBER}-{D.NAME}"))
        readings = (words, split(bare(without(m, D.NAME))), split(bare(m)))
        at_all = [defaultdict(list) for _ in readings]
        sizes = {len(part) for _, _, _, windows in asked for _, part in windows}
        for shapes, where in zip(readings, at_all, strict=True):
            for n in sizes:
                for at in range(len(shapes) - n + 1):
                    where[tuple(shapes[at : at + n])].append(at)
        for k, strong, places, windows in asked:
            offsets = defaultdict(lambda: (set(), set()))
            for (place, part), (kind, own) in windows.items():
                for at in at_all[kind].get(part, ()):
                    matched, pairs = offsets[at - place]
                    matched.add(place)
                    pairs |= {(w, w[0] + d) for w, d in zip(own, words[at : at + len(part)], strict=True) if slot(w)}
            for matched, pairs in offsets.values():
                enough = (strong and len(matched & strong) >= min(least, len(strong))) or len(matched) >= min(least, len(places))
                if enough and len({w for w, _ in pairs}) == len(pairs):
                    found.add((i, k))
    return found


def test_leaks_brute(docs, rows, spark):
    """Exactly the documents that loops over windows find, with items asked anew in other numbers and names too."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = np.random.default_rng(6)
    again = []
    for k, text in items:
        changed = re.sub(r"\d+", lambda m: str(int(m[0]) + 7), text)
        again += [
            (10_000 + 4 * k, f"Well, {changed} So it is."),
            (10_001 + 4 * k, text.lower()),
            (10_002 + 4 * k, re.sub(r"\d+", lambda m: str(rng.integers(1, 99)), text)),
            (10_003 + 4 * k, " ".join(text.split()[: len(text.split()) // 2])),
        ]
    mixed = [
        *rows,
        *again,
        (20_000, None),
        (20_001, ""),
        *[
            (30_000 + i, t)
            for i, t in enumerate([NAMED.replace("Rome", "Bonn"), NAMED.replace("Anna", "Carla"), "Tom drove 12 km in 2 hours"])
        ],
    ]
    asked = [*items, (900, NAMED), (901, "Tom drove 12 km in 2 hours, 30 km in 5 hours."), (902, "Yes")]
    found = {
        (r["doc_id"], r["item_id"])
        for r in leaks(
            spark.createDataFrame(mixed, "doc_id long, text string"),
            spark.createDataFrame(asked, "item_id long, text string"),
        ).collect()
    }
    assert found == brute_leaks(mixed, asked) and len(found) > 40


def test_templates(spark):
    item = "A farmer in town sold 12 apples to Mary for 3.50 dollars and then gave 12 more to John at 5 km distance."
    texts = [
        "Intro words. " + item.replace("Mary", "Alice").replace("12", "17").replace("3.50", "4,25") + " More text here.",
        item.replace("12 more", "99 more"),
        item.upper().replace("MARY", "Mary").replace("JOHN", "John"),
        "A farmer in town sold twelve pears and nothing else of note happened that day, said the mayor of the town.",
        item.replace("km", "miles"),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, item), (1, None), (2, "short one"), (3, "the mayor of the town")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs, items).collect()}
    assert set(got) == {(0, 0), (2, 0), (3, 3), (4, 0)} | ({(1, 0)} if (1, 0) in got else set())
    assert (1, 0) not in got, "12 can't be both 12 and 99"
    assert got[0, 0]["n_changed"] == 3 and got[0, 0]["coverage"] == 1 and got[2, 0]["n_changed"] == 0


DENSE = [
    "Tom drove 12 km in 2 hours, 30 km in 5 hours and 45 km in 9 hours.",
    "Compute 12 + 30 - 7 + 45 - 9 + 22.",
    "Compute 7 + 8.",
    "Yes",
]


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_dense_items(spark, most):
    """Items of numbers and units, and short ones: found word for word, and not with other numbers."""
    texts = [f"Before it. {x} After it." for x in DENSE] + ["Compute 13 + 31 - 8 + 46 - 10 + 23.", "Compute 7 + 9.", "Eyes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(DENSE), (9, "?!")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items, most=most).collect()} == {(i, i) for i in range(len(DENSE))}


NAMED = "Last summer Anna and Peter took the night train from Paris to Rome and met Carla in Milan."


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_names_anywhere(spark, most):
    """A word is read alike wherever it stands and however it is written."""
    city, opens = "What is the capital city of France?", "Mary has a dog and a cat at home. Mary likes the dog more than the cat."
    texts = [
        (f"Question: {city}", 0),
        (f"So {city}", 0),
        ("question: what is the capital city of Spain", 0),
        (city.lower(), 0),
        (city.upper(), 0),
    ]
    texts += [
        (NAMED.replace(" Paris", "\nParis").replace(" Rome", "\n Rome"), 1),
        (NAMED.lower(), 1),
        (NAMED.upper(), 1),
        ("Well, " + NAMED.replace("Paris", "Berlin").replace("Anna", "Olga"), 1),
    ]
    texts += [(opens.replace("Mary", "Alice"), 2), (opens.lower(), 2), (opens.replace("Mary likes", "Clearly she likes"), None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate([city, NAMED, opens])), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items, most=most).collect()}
    assert {x for x in got if texts[x[0]][1] is not None} == {(i, k) for i, (_, k) in enumerate(texts) if k is not None}


def test_clean_leaves_texts_where_they_are_read(spark):
    """Texts aren't dealt out anew to drop some; ids that are too many to broadcast give the same."""
    item = "a long question of nine words that nobody asks here twice in one day"
    rows = [(None if i % 100 == 3 else i, f"some {i} words" + (f" {item}" if i % 8 == 0 or i == 103 else "")) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were more ids than Spark broadcasts by itself
    try:
        got = clean(df, items)
        assert got.rdd.glom().filter(len).count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = Counter((i, t) for i, t in rows if i is not None and i % 8)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, clean(df, items, most=0).collect())) == want


# 7 -------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= share * weight[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def test_mixture(docs, spark, odd, none):
    for df in (docs, docs.withColumn("source", docs.source.substr(1, 4)), odd):
        got = rates(df).collect()
        sizes = defaultdict(int)
        for r in got:
            sizes[r["source"]] += r["size"]
        want = brute_targets(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(
            (r["doc_id"], len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")))
            for r in df.collect()
        )
        rate = {s: want[s] / n if n else 0 for s, n in sizes.items()}
        draw = lambda r: int(hashlib.md5(f"7:{'null' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:8], 16) / 2**32
        copies = Counter((r["doc_id"], int(rate[r["source"]] + 1 - draw(r))) for r in df.collect())
        assert Counter((r["doc_id"], r["copies"]) for r in got) == copies
        taken, target = sum(r["size"] * r["copies"] for r in got), sum(want.values())
        assert df is odd or abs(taken - target) < 0.1 * target  # odd has two documents of nearly all words
    assert rates(none).count() == 0
    mixed = mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rates(odd).collect())


def test_many_sources(spark):
    """Targets of thousands of sources, some empty, some of equal size, one null."""
    from tessera.llm.mixture import targets

    rng = np.random.default_rng(2)
    sizes = {f"host{i}": int(rng.integers(0, 50)) if i % 3 else 1000 * i for i in range(3000)} | {None: 77, "": 5}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert len(got) == len(sizes) and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_mixture_of_rows_without_ids(spark):
    """Rows of one doc_id or none are drawn each for itself."""
    df = spark.createDataFrame(
        [(None if i % 2 else 7, f"a few words {i}", "s" if i % 4 < 2 else "t") for i in range(4000)],
        "doc_id long, text string, source string",
    )
    got = rates(df).groupBy("source").agg({"copies": "sum", "target": "max"}).collect()
    assert all(abs(4 * r["sum(copies)"] - r["max(target)"]) < 0.05 * r["max(target)"] for r in got)


def test_mixture_in_as_many_tasks_as_texts_are_read(spark):
    """Two sources and none don't gather the texts in three tasks; a table of sources that is too large to broadcast gives the same."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(i, f"a few words {i}", ("s", "t", None)[i % 3]) for i in range(1600)],
        "doc_id long, text string, source string",
    ).repartition(16)
    got = mix(df)
    assert got.select(F.spark_partition_id().alias("task")).distinct().count() == 16
    assert Counter(got.collect()) == Counter(mix(df, held=0).collect()) != Counter()
    assert Counter(rates(df).collect()) == Counter(rates(df, held=0).collect())


# 8 -------------------------------------------------------------------------
def brute_components(expected, n, percent):
    sets = {}
    for i, t in expected:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets[i] = {tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_take_few_stages(spark):
    """Hubs, a path, loops and random links against a plain search; the driver keeps a record of each task of each stage."""
    rng = np.random.default_rng(4)
    hubs = [(0, i) for i in range(1, 500)] + [(900, i) for i in range(400, 800)] + [(5, 5)]
    path = [(i, i + 1) for i in range(40)]
    some = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    for links, most in ((hubs, 40), (path, 120), (some, None)):
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        want = {i: find(i) for a, b in links if a != b for i in (a, b)}
        before = scheduler.nextStageId()
        got = stars(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted((r["id"], r["component"]) for r in got) == sorted(want.items())
        assert most is None or scheduler.nextStageId() - before <= most


def test_driver_returns_freed_memory(spark):
    """Where the JVM has the command, it is carried out; a second call changes nothing."""
    from tessera.llm.storage import trim_driver

    version = [int(x) for x in spark.sparkContext._jvm.System.getProperty("java.version").split(".")[:3]]
    if version < [17, 0, 10]:
        pytest.skip("this JVM has no such command")
    assert trim_driver(spark) and trim_driver(spark)


def test_near(docs, rows):
    for n, percent in ((3, 85), (5, 80)):
        want = brute_components(rows, n, percent)
        got = by_id(near_dedup(docs, threshold=percent / 100, n=n))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_families(spark):
    """A large family of edited copies, chains just above the threshold, and families that share half."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    base = list(rng.choice(vocabulary, 120))
    for _ in range(700):
        w = list(base)
        for p in rng.choice(120, rng.integers(0, 5), replace=False):
            w[p] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    chain = list(rng.choice(vocabulary, 100))
    for _ in range(30):
        chain = chain[4:] + list(rng.choice(vocabulary, 4))
        texts.append(" ".join(chain))
    half = list(rng.choice(vocabulary, 60))
    texts += [" ".join([*half, *rng.choice(vocabulary, 40)]) for _ in range(150)]
    rows = list(enumerate(texts))
    want = brute_components(rows, 3, 85)
    got = by_id(near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.85, n=3))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_near_odd(odd, none):
    got = near_dedup(odd, threshold=0.85, n=3).collect()
    assert len(got) == odd.count()
    ids = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert ids[5]["component_id"] == ids[6]["component_id"] == 5 and ids[1]["n_shingles"] == 0 and ids[4]["n_shingles"] == 1
    assert ids[7]["component_id"] == 7 and ids[1]["component_id"] == 1
    assert sorted((r["component_id"], r["kept"], r["stays"]) for r in got if r["doc_id"] is None and r["n_shingles"]) == [(7, False, False)]
    assert [(r["component_id"], r["kept"], r["stays"]) for r in got if r["doc_id"] is None and not r["n_shingles"]] == [(None, True, True)]
    assert sum(r["stays"] for r in got if r["component_id"] == 7) == 1
    assert near_dedup(none).count() == 0


def test_near_rows(spark):
    """Repeated and null identifiers link nothing by themselves, and one row of each component stays."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [
        (1, a, 0),
        (1, b, 1),
        (1, b, 2),
        (2, a, 3),
        (None, b + " x", 4),
        (None, a, 5),
        (None, "c d e f", 6),
        (None, "c d e f", 7),
        (3, None, 8),
        (3, None, 9),
        (None, "", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = near_dedup(docs, threshold=0.8, n=5).collect()
    assert sum(r["stays"] for r in got) == 6
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert kept == sorted([(1, a), (1, b), (0, "c d e f"), (3, ""), (3, ""), (0, "")])


def test_near_blocks(spark, monkeypatch):
    """One cluster of many blocks: families that share half their words, compared block by block."""
    from tessera.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK_GRAMS", 500)
    monkeypatch.setattr(module, "TURNS", 1)
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    half = list(rng.choice(vocabulary, 70))
    texts = []
    for _ in range(60):
        own = list(rng.choice(vocabulary, 30))
        texts += [" ".join([*half, *own, *rng.choice(vocabulary, k)]) for k in (0, 2, 4)]
    rows = list(enumerate(texts))
    want = brute_components(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 20
    got = by_id(near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.85, n=3))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_banding():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        bands, rows = banding(threshold)
        assert bands * rows <= 256 and ((1 - threshold**rows) ** bands <= 1e-8 or rows == 1)


# 9 -------------------------------------------------------------------------
def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = by_id(identify(docs))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    shuffled = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'zz', lang) as lang")
    assert {i: r["lang_pred"] for i, r in by_id(identify(shuffled)).items()} == {i: r["lang_pred"] for i, r in got.items()}
    ids = [(r["doc_id"], r["lang_pred"]) for r in identify(odd).collect()]
    assert len(ids) == odd.count() and dict(ids)[1] == "und" and dict(ids)[12] == "und" and dict(ids)[8] == "en"
    assert identify(none).count() == 0
    assert {r["lang_pred"] for r in identify(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_many_languages(spark):
    """Every language is learned, also the three-hundredth, and their machines stay far below one for each two."""
    from tessera.llm.language_id import train

    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8, replace=False)
        words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 60)), f"x{k:03d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = train(docs)
    assert len(model["langs"]) == 300 and sum(map(len, model["families"].values())) == 300
    assert sum(map(len, model["pairs"].values())) < 10_000
    truth = {i: x for i, _, x in rows}
    held = [r for r in identify(docs).collect() if r["held_out"]]
    assert len(held) > 800 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9


# 10 ------------------------------------------------------------------------
def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["id"]: r["kept"] for r in resample(docs, labels).select("id", "kept").collect()}
    good = [r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()]
    bad = [r["doc_id"] for r in labels.filter("quality = 0").collect()]
    assert np.mean([kept[i] for i in good]) > 0.97 and np.mean([kept[i] for i in bad]) < 0.5
    out = resample(odd, labels)
    assert out.count() == odd.count() and out.select("row.*").columns == odd.columns
    assert resample(none, labels).count() == 0
    assert all(r["kept"] for r in resample(docs, labels.limit(0)).select("kept").collect())


def test_quality_held_out(spark):
    """Half of the labels hidden: good rows that no model has seen stay, whatever their length, and bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = {
        r["id"]: (r["kept"], r["n"])
        for r in resample(docs, labels.filter("doc_id % 2 = 0")).selectExpr("id", "kept", "size(split(row.text, ' ')) AS n").collect()
    }
    hidden = labels.filter("doc_id % 2 = 1")
    good = [kept[r["doc_id"]] for r in hidden.filter("quality = 1 and toxic = 0").collect()]
    bad = [kept[r["doc_id"]][0] for r in hidden.filter("quality = 0").collect()]
    assert np.mean([k for k, _ in good]) > 0.985 and np.mean(bad) < 0.2
    for low, high in ((0, 100), (100, 300), (300, 1000), (1000, 1 << 30)):
        share = [k for k, n in good if low <= n < high]
        assert len(share) > 20 and np.mean(share) > 0.95, (low, high, np.mean(share))


def test_quality_brute(spark, docs):
    """Counts, weights, keys and the sample against loops over tokens."""
    from pyspark.sql import functions as F

    from tessera.llm.quality import BITS, FOLDS, SMOOTH, fold, gumbel, sample
    from tessera.llm.textops import gram_hashes, word_hashes

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    given = docs.select("doc_id", "text", fold(F.col("doc_id")).alias("fold"), gumbel(F.col("doc_id"), 11).alias("noise")).collect()
    token = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+")
    one = functools.cache(lambda t: word_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0])
    two = functools.cache(lambda a, b: gram_hashes(np.array([a, b], np.uint64), 2)[0])
    grams = {}
    for r in given:
        hashes = [
            one(t)
            for t in token.findall((r["text"] or "").lower().encode() if (r["text"] or "").isascii() else low(r["text"]).encode())
        ]
        pairs = [two(a, b) for a, b in zip(hashes, hashes[1:], strict=False)]
        grams[r["doc_id"]] = Counter(int(h) >> (64 - BITS) for h in [*hashes, *pairs])
    raw, of = Counter(), [Counter() for _ in range(FOLDS)]
    for r in given:
        raw.update(grams[r["doc_id"]])
        if r["doc_id"] in good:
            of[r["fold"]].update(grams[r["doc_id"]])
    target = [sum((of[g] for g in range(FOLDS) if g != f), Counter()) for f in range(FOLDS)]
    mass = lambda c: np.log(sum(c.values()) + SMOOTH * (1 << BITS))
    ratio = lambda f, b: np.log(target[f][b] + SMOOTH) - mass(target[f]) - np.log(raw[b] + SMOOTH) + mass(raw)
    weight = {r["doc_id"]: sum(k * ratio(r["fold"], b) for b, k in grams[r["doc_id"]].items()) for r in given}
    many = {i: sum(c.values()) for i, c in grams.items()}
    held = [i for i in good if i in many and many[i]]
    centre = sum(weight[i] for i in held) / sum(many[i] for i in held)
    spread = np.mean([(weight[i] - centre * many[i]) ** 2 / many[i] for i in held]) ** 0.5
    key = {
        r["doc_id"]: (weight[r["doc_id"]] - centre * many[r["doc_id"]]) / (spread * max(many[r["doc_id"]], 1) ** 0.5) + r["noise"]
        for r in given
    }
    got = {r["id"]: r for r in sample(docs, labels).collect()}
    for i in weight:
        assert got[i]["n_grams"] == many[i] and got[i]["log_weight"] == pytest.approx(weight[i], abs=1e-6) and got[i]["key"] == pytest.approx(key[i], abs=1e-6)
    passing = sorted((key[i] for i in good if i in key), reverse=True)
    least = passing[len(passing) - int(0.005 * len(passing)) - 1]
    assert {i for i, r in got.items() if r["kept"]} == {i for i in key if key[i] >= least - 1e-9}
    top = sorted(key, key=lambda i: -key[i])[:50]
    assert {r["id"] for r in sample(docs, labels, k=50).filter("kept").collect()} == set(top)


def test_quality_few_labels(spark):
    docs = spark.createDataFrame([(i, f"some text {i} ... of words") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and r["log_weight"] == 0 for r in resample(docs, labels).collect())
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, two = ({r["id"]: r["key"] for r in resample(docs, labels, most=most).filter("kept").collect()} for most in (0, 1_000_000))
    assert one == pytest.approx(two)


def test_top_k(spark, docs):
    keys = scored(docs, np.zeros(1 << 16)).select("key")
    values = sorted((r["key"] for r in keys.collect()), reverse=True)
    for k in (1, 7, 100, len(values)):
        assert level_of_top(keys, k) == values[k - 1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert resample(docs, labels, k=50).filter("kept").count() == 50


# all -----------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, sf)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(want.select(*order).fetchall())


NAMES = [
    "copy",
    "leaking",
    "a b",
    "a.b",
    "__of",
    "__row",
    "size",
    "target",
    "row",
    "id",
    "hash",
    "rid",
    "named",
    "hashed",
    "rows",
    "source_size",
    "copies",
    "u",
    "fold",
    "kept",
    "key",
    "digest",
    "salt",
    "a`b",
]


def test_stages_with_any_columns(spark):
    """Extra columns of any name pass through every stage."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        quoted = [F.col("`" + c.replace("`", "``") + "`") for c in NAMES]
        assert [tuple(r) for r in out.select(*quoted).distinct().collect()] == [tuple(range(len(NAMES)))], name
    assert P.token_ids(spark, docs, SF).count() == docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in P.STAGES[:-1]:
        stage(spark, kept, SF).write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert kept.columns == columns and kept.count() > 0
        if name != "mixture":
            assert kept.count() < before.count() and kept.join(before, columns, "left_anti").count() == 0
    out = P.token_ids(spark, kept, SF)
    assert out.count() == kept.count() and P.run(spark, SF).count() == kept.count()
