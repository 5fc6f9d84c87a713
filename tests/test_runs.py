"""Resumable work, services, readers and writers, figures."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.ext import services
from leafmill.functions import codes, geometry, hashes
from leafmill.operators import evidence, memo, metrics, placement, routing
from leafmill.sources import readers, writers
from leafmill.streaming import resume


def items_of(spark, texts):
    return spark.createDataFrame([("draft", f"k-{t}", t) for t in texts], "stage string, key string, text string")


def test_resume_does_only_what_is_missing(spark, tmp_path):
    path, calls = str(tmp_path / "checkpoints"), []

    def work(rows):
        calls.append(sorted(r.key for r in rows.collect()))
        return services.called(rows, services.StandIn)

    first = resume.run(items_of(spark, ["a", "b", "a", "x [[fail]]"]), path, work, 1)
    assert {(r.text, r.payload) for r in first.collect()} == {("a", "A"), ("b", "B"), ("x [[fail]]", None)}
    again = resume.run(items_of(spark, ["a", "c", "x [[fail]]"]), path, work, 2)
    assert {(r.text, r.payload) for r in again.collect()} == {("a", "A"), ("c", "C"), ("x [[fail]]", None)}
    assert calls == [["k-a", "k-b", "k-x [[fail]]"], ["k-c", "k-x [[fail]]"]]
    stale = resume.run(items_of(spark, ["a"]), path, work, 3, valid=lambda rows: rows.where("payload <> 'A'"))
    assert calls[-1] == ["k-a"] and stale.count() == 1


def test_resume_as_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    items_of(spark, ["a", "b"]).write.parquet(source)
    stream = lambda: resume.stream(spark.readStream.schema("stage string, key string, text string").parquet(source), path, lambda r: services.called(r, services.StandIn), str(tmp_path / "state")).awaitTermination()
    stream()
    items_of(spark, ["b", "c"]).write.mode("append").parquet(source)
    stream()
    rows = resume.checkpoints(spark, path).collect()
    assert sorted((r.key, r.payload) for r in rows) == [("k-a", "A"), ("k-b", "B"), ("k-c", "C")]


def test_multiplicity(spark):
    rows = items_of(spark, ["a", "a", "b"])
    waiting = memo.once(memo.todo(rows, rows.where("text = 'b'")))
    assert [(r.text, r.multiplicity) for r in waiting.collect()] == [("a", 2)]
    assert tuple(memo.completed(rows, waiting).first()) == (1, 3)


def test_halving():
    class Short:
        def call(self, request):
            if len(request["text"].split()) > 2:
                raise RuntimeError("too long")
            return request["text"]

    assert services.with_halving(Short(), "a b c d e") == "a b c d e"
    with pytest.raises(RuntimeError):
        services.with_halving(Short(), " ".join("x" * 99), depth=1)
    assert services.request_key({"a": 1}, {"text": "x"}) != services.request_key({"a": 2}, {"text": "x"})


def test_text_files_with_marks(spark, tmp_path):
    for name, data in (("a", "Kapitola ž".encode()), ("b", b"\xef\xbb\xbf" + "Kapitola ž".encode()), ("c", "Kapitola ž".encode("utf-16"))):
        (tmp_path / f"{name}.txt").write_bytes(data)
    assert {r.text for r in readers.text_files(spark, str(tmp_path)).collect()} == {"Kapitola ž"}
    jobs = memo.imported(readers.files(spark, str(tmp_path)))
    assert jobs.count() == 3
    assert memo.code_fingerprint(readers.files(spark, str(tmp_path))).count() == 1


def test_wav(spark):
    sounds = spark.createDataFrame([(bytearray(b"\0\1" * 50), 24000, 1, 2)], "frames binary, sample_rate int, channels int, sample_width int")
    rows = writers.with_wav(sounds)
    whole = rows.first().content
    broken = spark.createDataFrame([(whole,), (whole[:-4],), (b"RIFF",), (None,)], "content binary")
    got = [r.wav for r in readers.wav_headers(broken).collect()]
    assert tuple(got[0]) == (1, 2, 24000, 50) and got[1:] == [None, None, None]


def test_whole_file(tmp_path):
    writers.whole_file("x", str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == "x" and len(list(tmp_path.iterdir())) == 1


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1, '{"a": "x"}'), (2, '{"a": "x", "a": "y"}'), (3, '{"a": 1}'), (4, "```json\n{}\n```"), (5, "no")], "id int, reply string")
    assert [tuple(r) for r in readers.text_maps(rows).collect()] == [(1, "a", "x")]
    assert sorted(r.id for r in readers.rejected(rows).collect()) == [2, 3, 5]
    good, bad = writers.split_invalid(rows, F.col("id") > 2)
    assert (good.count(), bad.count()) == (3, 2)


def test_json_artifacts(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"title": "T", "chapters": [{"id": "ch01"}]}, indent=1))
    row = readers.json_artifacts(spark, str(tmp_path / "book.json"), "title string, chapters array<struct<id string>>").first()
    assert (row.title, row.chapters[0].id) == ("T", "ch01")


def test_fingerprint_is_canonical_json(spark):
    import hashlib

    row = spark.createDataFrame([('a"\n', 3, None)], "s string, n int, z string").select(hashes.fingerprint(F.col("s"), F.col("n"), F.col("z")).alias("f")).first()
    assert row.f == hashlib.sha256(json.dumps([hashes.VERSION, 'a"\n', 3, None], separators=(",", ":")).encode()).hexdigest()


def test_request_summary(spark):
    rows = spark.createDataFrame([("s", float(n), "failed" if n == 1 else "success") for n in range(1, 21)] + [("t", 1.0, None)], "stage string, seconds double, status string")
    got = {r.stage: r for r in metrics.request_summary(rows).collect()}
    assert (got["s"].calls, got["s"].failed_attempts, got["s"].median_seconds, got["s"].p95_seconds) == (20, 1, 10.5, 19.0)
    assert got["t"].failed_attempts is None


def test_peak(spark):
    rows = spark.createDataFrame([(0, 5), (5, 7), (1, 9000), (4000, 4001)], "started long, ended long")
    assert metrics.peak_concurrency(rows).first().peak == 2


def test_routes(spark):
    box = "struct<x0 double, top double, x1 double, bottom double>"
    schema = f"page_no int, text string, page_width double, page_height double, images array<struct<role string, box {box}>>, visible_chars int, body_chars int"
    whole, small = (0.0, 0.0, 100.0, 100.0), (0.0, 0.0, 70.0, 60.0)
    rows = [
        (1, "", 100.0, 100.0, [("illustration", whole)], 0, 0), (2, "x" * 60, 100.0, 100.0, [], 60, 60), (3, "x" * 60, 100.0, 100.0, [("scan_background", whole)], 60, 60),
        (4, "", 100.0, 100.0, [], 0, 0), (5, "x" * 10, 100.0, 100.0, [("illustration", small)], 10, 0), (6, "x" * 10, 100.0, 100.0, [], 10, 10),
    ]
    pages = routing.classified(spark.createDataFrame(rows, schema))
    assert [r.route for r in routing.routes(pages).orderBy("page_no").collect()] == ["transcribe", "native", "transcribe", "transcribe", "transcribe", "transcribe"]
    assert [r.route for r in routing.routes(pages, narration=True).orderBy("page_no").collect()] == ["transcribe", "native", "native", "blank", "transcribe", "native"]
    native = routing.routes(pages.where("page_no in (1, 2)"), narration=True)
    assert [r.route for r in native.orderBy("page_no").collect()] == ["cover", "native"]


def test_images_and_boxes(spark):
    images = spark.createDataFrame([("i1", 2, 50.0), ("i2", 2, 5.0), ("i3", 3, 0.0), ("i4", 1, 0.0)], "image_id string, page_no int, top double")
    paragraphs = spark.createDataFrame([(1, "p1", 2, 2, 20.0), (2, "p2", 2, 2, 90.0)], "ord int, id string, page_no int, first_page int, bottom double")
    units = spark.createDataFrame([(0, "h", 2, "before_heading"), (1, "p1", 2, "before_paragraph")], "ord int, id string, page_no int, kind string")
    got = {r.image_id: (r.placement, r.target) for r in placement.place_images(images, paragraphs, units).collect()}
    assert got == {"i1": ("after_paragraph", "p1"), "i2": ("before_paragraph", "p1"), "i3": ("after_paragraph", "p2"), "i4": ("before_heading", "h")}
    row = spark.range(1).select(geometry.from_bounds(F.lit(-5.0), F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(100.0), F.lit(100.0)).alias("b"))
    assert tuple(row.first().b) == (0.0, 70.0, 20.0, 90.0)
    assert row.select(geometry.role(F.col("b"), F.lit(20.0), F.lit(20.0))).first()[0] == "scan_background"


def test_stylesheet_and_batches(spark):
    glossary = spark.createDataFrame([(1, "London", "Londýn", "city"), (2, "London", "Other", ""), (3, "", "x", "")], "ord int, term string, czech string, note string")
    register = spark.createDataFrame([(1, "A-B", "ty", None)], "ord int, pair string, form string, note string")
    text = evidence.stylesheet(glossary, register, "plain").first().text
    assert "- London → Londýn — city\n" in text and "Other" not in text and text.endswith("- A-B: ty\n")
    own = spark.createDataFrame([("b", "glossary", f"t{n:02d}", n, "x" * 100, [0]) for n in range(45)] + [("b", "register", "r", 0, "y" * 30_000, [0, 1])], "book string, kind string, identity string, ord int, json string, orders array<int>")
    profiles = spark.createDataFrame([("b", 0, "p" * 50), ("b", 1, "q" * 50)], "book string, ord int, json string")
    sizes = {r.batch: r["count"] for r in evidence.batches(own, profiles).groupBy("batch").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 5, 3: 1}


def test_messages_and_clamps(spark):
    rows = spark.createDataFrame([("auth",), ("new",)], "code string")
    messages = spark.createDataFrame([("auth", "m", "a"), ("unknown", "u", "q")], "code string, message string, action string")
    assert {tuple(r) for r in codes.with_messages(rows, messages).collect()} == {("auth", "m", "a"), ("new", "u", "q")}
    assert spark.range(1).select(codes.clamp(F.lit(99.0), 12, 24), codes.frames_to_ms(F.lit(60), F.lit(24000))).first() == (24.0, 2)


def test_document_of_parts(spark):
    texts = spark.createDataFrame([(1, "a", "One[[FN:n]] *"), (2, "b", "[[FN:n]]")], "ord int, id string, text string")
    bodies = spark.createDataFrame([("n", 1, "1", "body #"), ("m", 2, "2", "free")], "note_id string, note_ord int, label string, body string")
    own = writers.marked_up(texts, bodies.select("note_id", "body"))
    assert {r.id: r.markup for r in own.collect()} == {"a": "One#footnote[body \\#]<note-n> \\*", "b": "#footnote(<note-n>)"}
    assert [r.markup for r in writers.unused_notes(texts, bodies).collect()] == ["2. free"]
    assert writers.document(own).first().text.startswith("One")


def test_decoded_pages(spark):
    from leafmill.ext import decoders
    from leafmill.operators import layout

    files = spark.createDataFrame([("j", bytearray(b"One line\ngoes on\fPage two"))], "job_id string, content binary")
    found = layout.read(decoders.decoded_pages(files, decoders.plain_text)).orderBy("page_no").collect()
    assert [r.text for r in found] == ["One line goes on", "Page two"]
    text = "\n".join([f"line {k} " + "x" * 100 for k in range(50)])
    every = decoders.decoded_pages(spark.createDataFrame([("j", bytearray(text.encode()))], "job_id string, content binary"), decoders.plain_text)
    assert every.count() == len(text) - 49 and every.agg({"page_no": "max"}).first()[0] == 3


def test_stitched_wav(spark, tmp_path):
    import wave

    sounds = spark.createDataFrame([(n, bytearray(bytes([n, 0]) * 10)) for n in (2, 0, 1)], "number int, frames binary")
    assert writers.stitch_wav(sounds, str(tmp_path / "b.wav")) == 30
    with wave.open(str(tmp_path / "b.wav")) as reader:
        assert reader.readframes(99) == b"".join(bytes([n, 0]) * 10 for n in range(3))
