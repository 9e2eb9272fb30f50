import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.llm import bpe
from meridian.llm.packing import best_fit, lower_bound, pack, pack_documents
from meridian.llm.splitting import HEADINGS, outline, split_documents, _RANKS
from meridian.llm.tokens import load, sizes

import numpy as np

TEXTS = [
    None, "", " ", "\n\n \t", "a", "The crop's lay wasn't done — we've 12,345.678 m² of it!", "日本語のテキスト　と 123", "Ω≈ç√∫ ﬁeld é é", "<|endoftext|> is text", "a" * 3000, "ab" * 900, "\r\n\r\nx\r\n", "   leading", "trailing   ",
    "emoji 👩‍👩‍👧 🇬🇧", "  x  y\u0085z", "1" * 500, "!?" * 300, "Straße ÄÖÜ ñ ç", "\x00\x01\x02",
]


def test_ids_equal_the_public_tokenizer_and_decode(spark):
    rng = random.Random(1)
    more = ["".join(rng.choice("aAeé ñß1,.'\n -日Ж ") for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = list(enumerate(TEXTS + more)) + [(4, "a"), (None, "null key"), (5, TEXTS[5])]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, w string, i int")
    got = bpe.encode(df, "doc_id", "text").withColumn("back", bpe.decode(F.col("ids"))).collect()
    want = sorted((str(k), load().encode_ordinary(t) if t else [], t or "") for k, t in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.back) for r in got) == want
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_the_literal_of_common_words_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = {r.doc_id: list(r.ids) for r in bpe.encode(df, "doc_id", "text").collect()}
    monkeypatch.setattr(bpe, "HOT_WORDS", 3)
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df, "doc_id", "text").collect()} == plain


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=60))
def test_best_fit_and_its_bound(n):
    n = np.array(n)
    box = best_fit(n, 100)
    assert np.bincount(box, weights=n).max() <= 100
    assert lower_bound(n, 100) <= box.max() + 1


def test_bound_sees_large_items():
    assert lower_bound(np.array([60] * 10), 100) == 10 and lower_bound(np.array([34] * 6), 100) == 3


def test_packing_keeps_everything_and_cuts_only_what_exceeds(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 40, 55, 70, 100, 101, 250, 700])) for i in range(400)] + [(1, 3), (None, 5), (9999, None)]
    df = spark.createDataFrame([(k, n, "x", 7) for k, n in items], "id long, n int, piece string, container_id int")
    rows = pack(df, "id", "n", 100, partition_items=90).collect()
    assert sum(r["size"] for r in rows) == sum(n or 0 for _, n in items)
    assert {r.id for r in rows} == {k for k, _ in items}
    load_ = {}
    for r in rows:
        load_[r.container_id] = load_.get(r.container_id, 0) + r["size"]
        assert r.container_size <= 100
    assert max(load_.values()) <= 100
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.piece, r.start, r["size"]))
    for k, n in items:
        if n and n > 100:
            assert sorted(by[k]) == [(i, 100 * i, min(100, n - 100 * i)) for i in range(-(-n // 100))]
    assert len(load_) <= 1.03 * sum(n or 0 for _, n in items) / 100 + 5
    assert pack(df.limit(0), "id", "n", 100).count() == 0


def test_partitions_with_gaps_exchange_items(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randrange(20, 60)) for i in range(900)], "id long, n int")
    for size in (60, 450, 2000):
        rows = pack(df, "id", "n", 100, partition_items=size).collect()
        assert {r.id for r in rows} == set(range(900)) and len(rows) == 900
        boxes = {}
        for r in rows:
            boxes.setdefault(r.container_id, []).append(r)
        assert all(sum(r["size"] for r in b) <= 100 and len({r.certified for r in b}) == 1 for b in boxes.values())
    exact = pack(spark.createDataFrame([(i, 50) for i in range(100)], "id long, n int"), "id", "n", 100, partition_items=20).collect()
    assert len({r.container_id for r in exact}) <= 55 and any(r.certified for r in exact)


def test_documents_are_packed_by_their_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = pack_documents(df, "doc_id", "text", 64).collect()
    assert {r.doc_id for r in rows} == set(range(len(TEXTS)))
    counts = {r.doc_id: r.tokens for r in sizes(df, "doc_id", "text").collect()}
    assert counts[0] == counts[1] == 0 and sum(r["size"] for r in rows) == sum(counts.values())


LONG = [
    "# A\n\n" + "\n\n".join(f"Paragraph {i} has a few words. And a second sentence, {i}." for i in range(120)),
    "\n".join(f"- item {i} of a list" for i in range(300)), "x" * 4000, "日本語の文です。" * 400, "one long line " * 500, "a\r\n" * 900, "é" * 2000 + " " + "word " * 300, "!" * 3000, ("word " * 90 + "\n\n") * 8,
]


def test_pieces_tile_within_limits(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(LONG + TEXTS)] + [(0, LONG[0], "", 2)], "doc_id long, text string, piece string, start int")
    rows = split_documents(df, "doc_id", "text", 512, 64).collect()
    count = lambda t: len(load().encode_ordinary(t))
    every = dict(enumerate(LONG + TEXTS))
    assert {r.doc_id for r in rows} == {i for i, t in every.items() if t and count(t) > 512}
    seen = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        seen.setdefault((r.doc_id, r.piece), r)
    by = {}
    for (doc, _), r in seen.items():
        by.setdefault(doc, []).append(r)
    for doc, pieces in by.items():
        text = every[doc]
        assert pieces[0].start == 0 and pieces[-1].end == len(text)
        for r in pieces:
            assert r.text == text[r.start : r.end] and r.tokens == count(r.text) <= 512
        for a, b in zip(pieces, pieces[1:]):
            assert a.start < b.start <= a.end < b.end and count(text[b.start : a.end]) <= 64
    assert all(text_end in ".\n" for r in by[0][:-1] for text_end in r.text[-1])
    assert split_documents(df.limit(0), "doc_id", "text").count() == 0


def test_an_outline_has_depth():
    text = "# One\n\nintro\n\n## Two\n\n- a\n  - b\n    - c\n- d\n\nUnder\n-----\ntext\n<div><ul><li>x<li>y</ul></div>\n"
    cuts = outline(text)
    at = lambda name, depth=0: [text[i:].split("\n")[0] for i in cuts[_RANKS[name] + depth]]
    assert at("heading", 0) == ["# One"] and at("heading", 1) == ["## Two", "Under"] and not any(cuts[_RANKS["heading"] + d] for d in range(2, HEADINGS))
    assert [at("item", d) for d in range(3)] == [["- a", "- d"], ["  - b"], ["    - c"]]
    assert at("markup", 0) == ["<div><ul><li>x<li>y</ul></div>", ""] and at("markup", 1) == ["<ul><li>x<li>y</ul></div>", "</div>"] and at("markup", 2) == ["<li>x<li>y</ul></div>", "<li>y</ul></div>"]


def test_deep_subtrees_are_kept_whole_before_shallow_ones_are_opened(spark):
    part = lambda n: "".join(f"Sentence {i} of the part. " for i in range(n))
    text = "".join(f"# Chapter {c}\n\n" + "".join(f"## Section {c}.{k}\n\n{part(25)}\n\n" for k in range(4)) for c in range(3))
    rows = split_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", 512, 0).orderBy("piece").collect()
    assert all(r.text.startswith("#") for r in rows) and sum(r.text.startswith("# Chapter") for r in rows) == 3


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_words_make_up_the_text(spark, text):
    assert "".join(spark.createDataFrame([(text,)], "t string").select(bpe.words_of(F.col("t")).alias("w")).first().w) == text


def test_words_are_cut_alike_in_python_and_in_the_jvm(spark):
    rng = random.Random(5)
    spaces = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000"
    signs = spaces + "aZé_'’sʼ½²Ⅻ٣ⅳ७日ー゛ｶ\u0301\u200d-.,😀𝒜𝟙𐍈\x00\x01"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["it's we've 'S 'sx  's\n\n x \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bpe.words_of(F.col("t")).alias("w")).collect()
    cut = bpe.cutter()
    assert not [r.t for r in rows if cut(r.t) != list(r.w)]


def test_a_text_of_very_many_words_of_its_own(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40_000)).replace("1", "é")
    monkeypatch.setattr(bpe, "HOT_WORDS", 2)
    got = bpe.encode(spark.createDataFrame([(1, text), (2, "w5 é")], "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: list(r.ids) for r in got} == {1: load().encode_ordinary(text), 2: load().encode_ordinary("w5 é")}
