"""Texts for narration: bounded chunks, their order, and where they are in the sound."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import codes
from leafmill.functions import text as tx

NEIGHBOUR_CHARS, SAMPLE_RATE, MOST_WAV_BYTES = 100, 24_000, 0xFFFFFFFF - 36
# Fixed value: the end of a sentence and what may close it.
_SENTENCE = re.compile("[.!?…][\"'”’»)]?\\s+")


def split_one(text: str | None, max_chars: int | None = None, max_bytes: int | None = None) -> list[str]:
    """text in chunks within the limits: cut after a sentence, else at a space, else within a word."""
    if max_chars is None and max_bytes is None:
        raise ValueError("one limit is needed at least")
    if (max_chars is not None and max_chars < 1) or (max_bytes is not None and max_bytes < 4):
        raise ValueError("the limits must hold one sign")
    rest, out = " ".join((text or "").split()), []
    while rest:
        head = rest if max_chars is None else rest[:max_chars]
        if max_bytes is not None:
            head = head[:max_bytes].encode()[:max_bytes].decode(errors="ignore")
        if len(head) < len(rest):
            ends = [m.end() for m in _SENTENCE.finditer(head)]
            space = head.rfind(" ")
            head = head[: ends[-1] if ends else space if space > 0 else len(head)]
        out.append(head.strip())
        rest = rest[len(head) :].lstrip()
    return out


def split(c: Column | str, max_chars: int | None = None, max_bytes: int | None = None) -> Column:
    """An array of the text's chunks; its cuts depend on each other, so that it is a function of whole texts."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split_one(t, max_chars, max_bytes))

    return cut(c)


def chunks(chapters: DataFrame, max_chars: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """chapter_no, number, text, previous_text, future_text of chapters (chapter_no, text)."""
    rows = chapters.select("chapter_no", F.posexplode(split("text", max_chars, max_bytes)).alias("number", "text"))
    return with_neighbours(rows, "chapter_no", "number")


def with_neighbours(rows: DataFrame, key: str, order: str, n: int = NEIGHBOUR_CHARS) -> DataFrame:
    """rows with the last and first n signs of the texts before and after, within the key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumns({"previous_text": F.coalesce(F.right(F.lag("text").over(w), F.lit(n)), F.lit("")), "future_text": F.coalesce(F.left(F.lead("text").over(w), F.lit(n)), F.lit(""))})


def chapter_scripts(texts: DataFrame, notes: DataFrame, readers: DataFrame, unanchored: DataFrame) -> DataFrame:
    """chapter_no, text: what is read in each chapter, parts with a blank line between.

    texts: chapter_no, ord, id, text (a heading or paragraph); notes: note_id,
    note_ord, text; readers: ord, turn, note_id; unanchored: note_id, chapter_no.
    A note follows the text that reads it first; notes without an anchor come last.
    """
    body = notes.select("note_id", "note_ord", F.concat(F.lit("Poznámka: "), tx.spoken("text")).alias("text"))
    said = texts.select("chapter_no", F.struct(F.lit(0).alias("a"), F.col("ord").cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("_at"), tx.spoken("text").alias("text"))
    own = readers.join(texts.select("ord", "chapter_no"), "ord").join(body, "note_id")
    own = own.select("chapter_no", F.struct(F.lit(0).alias("a"), F.col("ord").cast("long").alias("b"), F.col("turn").cast("long").alias("c")).alias("_at"), "text")
    left = unanchored.join(body, "note_id").select("chapter_no", F.struct(F.lit(1).alias("a"), F.col("note_ord").cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("_at"), "text")
    parts = F.sort_array(F.collect_list(F.struct("_at", "text")))
    return said.unionByName(own).unionByName(left).groupBy("chapter_no").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n\n").alias("text"))


def offsets(sounds: DataFrame, rate: int = SAMPLE_RATE, key: str = "book", order: str = "number") -> DataFrame:
    """sounds (frames) with start_frame, start_ms, end_ms, in order within the key."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = sounds.withColumn("start_frame", F.coalesce(F.sum("frames").over(before), F.lit(0)))
    return out.withColumns({"start_ms": codes.frames_to_ms(F.col("start_frame"), F.lit(rate)), "end_ms": codes.frames_to_ms(F.col("start_frame") + F.col("frames"), F.lit(rate))})


def too_large(sounds: DataFrame, frame_bytes: int = 2, key: str = "book") -> DataFrame:
    """Keys whose sound would not fit into one WAV file."""
    return sounds.groupBy(key).agg((F.sum("frames") * frame_bytes).alias("n_bytes")).where(F.col("n_bytes") > MOST_WAV_BYTES)


def chapter_spans(placed: DataFrame, key: str = "book", order: str = "number", chapter: str = "chapter_id") -> DataFrame:
    """key, span, chapter, start_ms, end_ms: runs of consecutive chunks of one chapter."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(chapter).eqNullSafe(F.lag(chapter).over(w)), F.lit(0)).otherwise(F.lit(1))
    runs = placed.withColumn("_new", new).withColumn("span", F.sum("_new").over(w).cast("int"))
    return runs.groupBy(key, "span", chapter).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def manifest(spans: DataFrame, titles: DataFrame, key: str = "book") -> DataFrame:
    """key, manifest: a JSON object with the title, the duration and the chapters in order."""
    own = F.sort_array(F.collect_list(F.struct("span", F.struct(F.col("chapter_id").alias("id"), F.col("title").alias("title"), "start_ms", "end_ms").alias("c"))))
    rows = spans.groupBy(key).agg(F.transform(own, lambda x: x.c).alias("chapters"), F.max("end_ms").alias("duration_ms"))
    return rows.join(titles.select(key, F.col("title").alias("_title")), key).select(key, F.to_json(F.struct(F.lit(1).alias("version"), F.col("_title").alias("title"), "duration_ms", "chapters")).alias("manifest"))


def ffmetadata(spans: DataFrame, titles: DataFrame, key: str = "book") -> DataFrame:
    """key, metadata: the chapter marks as an encoder reads them."""
    mark = F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s", F.col("start_ms"), F.col("end_ms"), tx.escape_metadata("title"))
    marks = F.sort_array(F.collect_list(F.struct("span", mark.alias("m"))))
    rows = spans.groupBy(key).agg(F.array_join(F.transform(marks, lambda x: x.m), "\n").alias("_m"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), tx.escape_metadata("_title"))
    return rows.join(titles.select(key, F.col("title").alias("_title")), key).select(key, F.concat(head, F.lit("\n"), F.col("_m"), F.lit("\n")).alias("metadata"))
