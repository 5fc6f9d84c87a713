"""A book read aloud: from checked texts to sounds, their places, chapter marks and one file."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.ext import clients, services
from leafmill.functions import hashes
from leafmill.operators import contracts, notes, speech
from leafmill.sources import writers
from leafmill.streaming import resume

FRAME_BYTES = 2


class Spoken:
    """A voice that takes its request, with what is around the text, as JSON in `text`."""

    def __init__(self, voice: object):
        self.voice, self.identity = voice, voice.identity

    def call(self, request: dict) -> str:
        return self.voice.call(json.loads(request["text"]))


def checked(source: DataFrame, final: DataFrame) -> DataFrame:
    """final (id, text) with the source's chapter_no and ord; raises unless it is a full answer to source (chapter_no, ord, id, text) and says something."""
    contracts.enforce(contracts.duplicates(source, "id"), "ids that occur twice")
    contracts.enforce(contracts.text_map_violations(source, final), "texts that are no full translation")
    if source.isEmpty():
        raise contracts.ContractError("there is nothing to read")
    return final.select("id", "text").join(source.select("id", "chapter_no", "ord"), "id")


def requests(texts: DataFrame, bodies: DataFrame, chapter_pages: DataFrame, mode: str) -> DataFrame:
    """stage, key, chapter_no, number, text: a request for each chunk that a voice of this mode takes.

    texts: chapter_no, ord, id, text; bodies: note_id, note_ord, source_page, text. A
    note is read after the text that refers to it first, one without a reference
    at the end of its page's chapter.
    """
    limits = clients.LIMITS[mode]
    scripts = speech.chapter_scripts(texts, bodies, notes.readers(texts, bodies), notes.unanchored(bodies, texts, chapter_pages))
    chunks = speech.chunks(scripts, limits["max_chars"], limits["max_bytes"])
    around = [F.col(c) if limits["around"] else F.lit("") for c in ("previous_text", "future_text")]
    key = hashes.speech_key(F.col("text"), *around)
    text = F.to_json(F.struct("text", around[0].alias("previous_text"), around[1].alias("future_text")))
    return chunks.select(F.lit("speech").alias("stage"), key.alias("key"), "chapter_no", "number", text.alias("text"))


def spoken(asked: DataFrame, path: str, voice: Callable[[], object], order: int, parts: int = 4) -> DataFrame:
    """asked with frames; what was spoken before is not spoken again, equal requests once. Raises if a sound is missing.

    voice() is checked on the driver before anything is paid for; parts bounds how
    many voices speak at once.
    """
    voice().check()
    found = resume.run(asked, path, lambda rows: services.called(rows.repartition(parts, "key"), lambda: Spoken(voice()), attempts=1), order)
    sounds = found.withColumn("frames", F.unbase64("payload")).drop("payload")
    lost = sounds.where(F.col("frames").isNull() | (F.octet_length("frames") % FRAME_BYTES != 0)).select("chapter_no", "number")
    contracts.enforce(lost, "chunks without a sound")
    return sounds


def placed(sounds: DataFrame, titles: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """The manifest and the encoder's chapter marks of sounds (chapter_no, number, frames), a row each.

    titles: chapter_no, title; a chapter without one is called by its number.
    """
    rows = sounds.select(F.lit(book).alias("book"), F.struct("chapter_no", "number").alias("number"), F.col("chapter_no").cast("string").alias("chapter_id"), (F.octet_length("frames") / FRAME_BYTES).cast("long").alias("frames"))
    spans = speech.chapter_spans(speech.offsets(rows))
    named = spans.join(titles.select(F.col("chapter_no").cast("string").alias("chapter_id"), "title"), "chapter_id", "left").withColumn("title", F.coalesce("title", "chapter_id"))
    whole = sounds.sparkSession.createDataFrame([(book, book)], "book string, title string")
    return speech.manifest(named, whole), speech.ffmetadata(named, whole)


def narrate(source: DataFrame, final: DataFrame, bodies: DataFrame, chapter_pages: DataFrame, titles: DataFrame, book: str, mode: str, voice: Callable[[], object], folder: str, order: int) -> DataFrame:
    """Reads a book's final texts aloud: writes book.wav, chapters.json and chapters.txt into folder, and returns the sounds.

    A run that was broken off goes on where it was: sounds are kept below folder.
    """
    asked = requests(checked(source, final), bodies, chapter_pages, mode)
    sounds = spoken(asked, f"{folder}/sounds", voice, order)
    manifest, marks = placed(sounds, titles, book)
    ranked = sounds.select(F.struct("chapter_no", "number").alias("number"), "frames")
    writers.stitch_wav(ranked, f"{folder}/book.wav")
    writers.whole_file(manifest.first().manifest, f"{folder}/chapters.json")
    writers.whole_file(marks.first().metadata, f"{folder}/chapters.txt")
    return sounds
