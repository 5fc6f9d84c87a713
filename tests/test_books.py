"""Segmentation, notes, packing and narration on hand-made books."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import contracts, notes, overlay, packing, segment, speech
from leafmill.operators.contracts import ContractError


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_split_paragraphs(spark):
    text = "A line\n that goes on\n\nA bro-\nken word\n \n- a dash -\nstays\n\n\n"
    assert one(spark, tx.split_paragraphs("t"), t=text) == ["A line that goes on", "A broken word", "- a dash - stays"]


def test_join_lines_only_before_small_letters(spark):
    lines = spark.createDataFrame([(["Anna-", "Maria came-", "back"],)], "l array<string>")
    assert lines.select(tx.join_hyphenated(F.col("l"))).first()[0] == "Anna- Maria cameback"


@pytest.mark.parametrize(("text", "heading"), [
    ("Chapter 1", True), ("KAPITOLA druhá", True), ("IV.", True), ("12", True), ("1234", False), ("## Any title", True),
    ("## Stop! he cried.", False), ("## Stop!", True), ("„PTEJTE SE“", False), ("THE END", True), ("THE END.", False), ("A", False),
    ("Plain words here", False), ("W" * 41, False), ("chapterless talk", False), ("Глава 3", True),
])
def test_headings(spark, text, heading):
    assert one(spark, tx.is_heading("t"), t=text) is heading


def test_margin_key_and_anchors(spark):
    assert one(spark, tx.margin_key("t"), t="  Straße   12 \t of 345 ") == "strasse # of #"
    assert one(spark, tx.note_ids("t"), t="a[[FN:x.1]]b[[FN:a/b]]") == ["x.1"]
    assert one(spark, tx.note_ids("t", wide=True), t="a[[FN:x.1]]b[[FN:a/b]]") == ["x.1", "a/b"]
    for text, exact in (("1842.", True), ("[[FN:fn-1]]", True), ("]", True), ("a", False)):
        assert one(spark, tx.is_immutable("t"), t=text) is exact


def test_escapes_and_names(spark):
    assert one(spark, tx.escape_markup("t"), t="a*b_[c]\\") == "a\\*b\\_\\[c\\]\\\\"
    assert one(spark, tx.escape_metadata("t"), t="a=b;#\\\n") == "a\\=b\\;\\#\\\\ "
    assert one(spark, tx.safe_name("t"), t=' a/b:"c" ') == "abc"
    assert one(spark, tx.safe_name("t", audio=True), t=" ..?? ") == "kniha"
    assert one(spark, tx.without_fence("t"), t="```json\n{}\n```") == "{}"


@pytest.mark.parametrize("n", range(4, 12))
def test_utf8_prefix(spark, n):
    for text in ("aŘŘbé", "a\U0001f600b\U0001f600", "", "abc"):
        want = text.encode()[:n].decode(errors="ignore")
        assert one(spark, tx.utf8_prefix("t", n), t=text) == want


PAGES = [
    (1, [("heading", "## One"), ("paragraph", "It began in"), ("paragraph", "the end.")]),
    (2, [("paragraph", "and went on"), ("heading", "Two"), ("paragraph", "New text without end")]),
    (3, [("paragraph", "that ends here."), ("paragraph", "small start after a stop.")]),
    (4, [("image", "x"), ("paragraph", " "), ("paragraph", "# Kept as prose")]),
]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [("b", page, n, kind, text) for page, own in PAGES for n, (kind, text) in enumerate(own)]
    return spark.createDataFrame(rows, "book string, page_no int, ord int, type string, text string")


def test_paragraphs_and_ids(blocks):
    got = {r.id: (r.text, r.source_pages) for r in segment.paragraphs(blocks).collect()}
    assert got == {
        "ch01-p001": ("It began in", [1]), "ch01-p002": ("the end.", [1]), "ch01-p003": ("and went on", [2]),
        "ch02-p001": ("New text without end that ends here.", [2, 3]), "ch02-p002": ("small start after a stop.", [3]), "ch02-p003": ("Kept as prose", [4]),
    }


def test_leading_text_opens_a_chapter(spark):
    own = spark.createDataFrame([("b", 1, 0, "paragraph", "Before."), ("b", 1, 1, "heading", "Chapter 1"), ("b", 1, 2, "paragraph", "After.")], "book string, page_no int, ord int, type string, text string")
    assert sorted(r.id for r in segment.paragraphs(own).collect()) == ["ch01-p001", "ch02-p001"]
    assert [r.id for r in segment.headings(own).collect()] == ["ch02-h000"]


def test_entries_in_order(spark, blocks):
    titles = spark.createDataFrame([("b", "Title")], "book string, title string")
    own_notes = spark.createDataFrame([("b", 1, "fn-p0001-001", "note")], "book string, note_ord int, note_id string, text string")
    got = [r.id for r in segment.entries(blocks, titles, own_notes).orderBy("ord").collect()]
    assert got == ["book-title", "ch01-h000", "ch01-p001", "ch01-p002", "ch01-p003", "ch02-h000", "ch02-p001", "ch02-p002", "ch02-p003", "fn-p0001-001"]


def test_note_bodies_over_pages(spark):
    bodies = spark.createDataFrame([("b", "n1", 1, "It goes on-"), ("b", "n2", 1, "alone ")], "book string, note_id string, source_page int, text string")
    more = spark.createDataFrame([("b", "n1", 3, 0, "more"), ("b", "n1", 2, 0, " ward and ")], "book string, note_id string, page_no int, ord int, text string")
    got = {r.note_id: (r.text, r.source_pages) for r in notes.whole_bodies(bodies, more).collect()}
    assert got == {"n1": ("It goes onward and more", [1, 2, 3]), "n2": ("alone ", [1])}
    lost = more.withColumn("note_id", F.lit("zz"))
    assert notes.orphans(lost, bodies).count() == 2


def test_last_note_is_from_an_earlier_page(spark):
    own = spark.createDataFrame([("b", 1, 0, "n1"), ("b", 1, 1, "n2"), ("b", 3, 0, "n3")], "book string, page_no int, ord int, note_id string")
    more = spark.createDataFrame([("b", 1, 0, None, "x"), ("b", 2, 0, None, "y"), ("b", 3, 0, None, "z"), ("b", 4, 0, "n1", "w")], "book string, page_no int, ord int, note_id string, text string")
    assert {r.text: r.note_id for r in notes.with_last_note(more, own).collect()} == {"x": None, "y": "n2", "z": "n2", "w": "n1"}


def pack_plain(counts, limit):
    out, chunk, held = [], 0, None
    for n in counts:
        if held is not None and held + n > limit:
            chunk, held = chunk + 1, None
        held = (held or 0) + n
        out.append(chunk)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=25), min_size=1, max_size=4), st.integers(1, 40))
def test_pack(spark, books, limit):
    rows = [(f"c{b}", n, w) for b, own in enumerate(books) for n, w in enumerate(own)]
    df = spark.createDataFrame(rows, "chapter string, ord int, words int")
    got = {(r.chapter, r.ord): r.chunk for r in packing.pack(df, limit).collect()}
    assert got == {(f"c{b}", n): c for b, own in enumerate(books) for n, c in enumerate(pack_plain(own, limit))}


def test_pack_limits(spark):
    df = spark.createDataFrame([("c", n, 100) for n in range(80)], "chapter string, ord int, words int")
    assert packing.pack(df, 3000).select("chunk").distinct().count() == 3
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_book_chunks(spark):
    entries = [(1, "book-title", None, "title", "T t"), (2, "ch01-h000", "ch01", "heading", "H"), (3, "ch01-p001", "ch01", "paragraph", "a b c"), (4, "ch01-p002", "ch01", "paragraph", "d e"), (5, "n1", "footnotes", "note", "n n")]
    df = spark.createDataFrame(entries, "ord int, id string, chapter string, kind string, text string")
    got = {r.chunk_key: (r.kind, r.text, r.context_before, r.context_after) for r in packing.book_chunks(df, 6).collect()}
    assert got == {"ch01-0": ("prose", "T t\n\nH\n\na b c", "", "d e"), "ch01-1": ("prose", "d e", "T t H a b c", ""), "footnotes-0": ("footnotes", "n n", "", "")}
    assert [r.chunk_key for r in packing.book_chunks(df.where("kind = 'title'"), 6).collect()] == ["front-0"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab .!?é…”\n\U0001f600", max_size=120), st.integers(1, 30), st.integers(4, 40))
def test_split_text(text, chars, size):
    whole = " ".join(text.split())
    for limits in ({"max_chars": chars}, {"max_bytes": size}, {"max_chars": chars, "max_bytes": size}):
        parts = speech.split_one(text, **limits)
        assert "".join(parts).replace(" ", "") == whole.replace(" ", "")
        assert all(p and p == p.strip() and len(p) <= limits.get("max_chars", 999) and len(p.encode()) <= limits.get("max_bytes", 999) for p in parts)


def test_split_prefers_sentences():
    assert speech.split_one("One two. Three four five", max_chars=15) == ["One two.", "Three four five"]
    assert speech.split_one("x" * 10_000, max_chars=1800)[0] == "x" * 1800
    with pytest.raises(ValueError):
        speech.split_one("a")


def test_narration(spark):
    texts = spark.createDataFrame([(1, 1, "ch01-h000", "One[[FN:b]]"), (1, 2, "ch01-p001", "Text[[FN:a]] and[[FN:b]]"), (2, 3, "ch02-p001", "End[[FN:a]]")], "chapter_no int, ord int, id string, text string")
    own = spark.createDataFrame([("a", 1, "body a", 1), ("b", 2, "body b", 1), ("c", 3, "body c", 1), ("d", 4, "body d", 9)], "note_id string, note_ord int, text string, source_page int")
    pages = spark.createDataFrame([(1, 1), (2, 2)], "chapter_no int, page_no int")
    free = notes.unanchored(own, texts, pages)
    got = {r.chapter_no: r.text for r in speech.chapter_scripts(texts, own, notes.readers(texts, own), free).collect()}
    assert got == {
        1: "One\n\nPoznámka: body b\n\nText and\n\nPoznámka: body a\n\nPoznámka: body c",
        2: "End\n\nPoznámka: body d",
    }


def test_contracts(spark):
    source = spark.createDataFrame([("a", "1842."), ("b", "Text[[FN:n1]]"), ("c", "More")], "id string, text string")
    found = lambda rows, **k: sorted(tuple(r) for r in contracts.text_map_violations(source, spark.createDataFrame(rows, "id string, text string"), **k).collect())
    good = [("a", "1842."), ("b", "[[FN:n1]]Český"), ("c", "Více")]
    assert found(good) == []
    assert found([("a", "1842")], partial=True) == [("a", "immutable")]
    assert found([*good, ("x", "new")]) == [("x", "extra")]
    assert found([("a", "1842."), ("b", "Český"), ("c", " ")]) == [("b", "anchors"), ("c", "blank")]
    with pytest.raises(ContractError, match="missing"):
        contracts.enforce(contracts.text_map_violations(source, source.where("id <> 'a'")), "reply")
    contracts.enforce(contracts.text_map_violations(source, source), "reply")
    assert contracts.config_violations({"workers": 33, "font_size": 12, "reasoning_effort": "all"}) == ["workers", "reasoning_effort"]


def test_overlay(spark):
    ids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord int, id string")
    draft = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, text string")
    patches = spark.createDataFrame([("b", "B2"), ("a", " "), ("x", "X")], "id string, text string")
    rows = overlay.overlay(ids, draft, patches)
    assert [(r.id, r.text) for r in rows.orderBy("ord").collect()] == [("a", "A"), ("b", "B2"), ("c", None)]
    assert [r.id for r in overlay.missing(rows).collect()] == ["c"]
    low = spark.createDataFrame([("k", "1"), ("m", "2")], "name string, value string")
    high = spark.createDataFrame([("k", "")], "name string, value string")
    assert {tuple(r) for r in overlay.layered(low, high).collect()} == {("k", ""), ("m", "2")}


def test_language_samples(spark, blocks):
    long = spark.createDataFrame([("x", 1, 0, "paragraph", "a" * 1500 + "b" * 1500), ("y", 1, 0, "paragraph", "short")], "book string, page_no int, ord int, type string, text string")
    got = {(r.book, r.sample_no): r.sample for r in segment.language_samples(long).collect()}
    whole = "a" * 1500 + "b" * 1500
    assert got == {("x", 0): whole[:2000], ("x", 1): whole[500:2500], ("x", 2): whole[1000:], ("y", 0): "short"}
    answers = spark.createDataFrame([("x", "en"), ("x", "en"), ("y", "English"), ("z", "cs"), ("z", "en")], "book string, lang string")
    assert {tuple(r) for r in segment.unanimous(answers).collect()} == {("x", "en"), ("y", "unknown"), ("z", "unknown")}
