"""Writers: tables of checkpoints, single files that appear whole, WAV files, markup."""

from __future__ import annotations

import io
import os
import tempfile
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions import text as tx


def append_checkpoints(rows: DataFrame, path: str) -> None:
    """Adds results (stage, key, payload, ord); of equal keys the largest ord counts when they are read."""
    rows.select("stage", "key", "payload", "ord").write.mode("append").partitionBy("stage").parquet(path)


def whole_file(text: str, path: str) -> None:
    """Writes one small file of the driver's, such as a report: it appears whole or not at all."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def split_invalid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """rows that are valid, and the others for a table of their own."""
    good = F.coalesce(valid, F.lit(False))
    return rows.where(good), rows.where(~good)


def with_wav(sounds: DataFrame) -> DataFrame:
    """sounds (frames: binary, sample_rate, channels, sample_width) with content, a WAV file."""

    @F.pandas_udf("binary")
    def content(frames: pd.Series, rate: pd.Series, channels: pd.Series, width: pd.Series) -> pd.Series:
        def one(data: bytes, r: int, c: int, w: int) -> bytes:
            sink = io.BytesIO()
            with wave.open(sink, "wb") as out:
                out.setparams((int(c), int(w), int(r), 0, "NONE", None))
                out.writeframes(data)
            return sink.getvalue()

        return pd.Series([one(*x) for x in zip(frames, rate, channels, width)])

    return sounds.withColumn("content", content("frames", "sample_rate", "channels", "sample_width"))


def stitch_wav(sounds: DataFrame, path: str, rate: int = 24_000, channels: int = 1, width: int = 2) -> int:
    """Writes sounds (number, frames: binary) in order into one WAV file on the driver, a sound at a time; its frames.

    One file of one book is one stream; it may not exceed what a WAV header can say.
    """
    total = sounds.agg(F.coalesce(F.sum(F.octet_length("frames")), F.lit(0))).first()[0]
    if total > 0xFFFFFFFF - 36:
        raise ValueError("the sound does not fit into a WAV file")
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as sink, wave.open(sink, "wb") as out:
            out.setparams((channels, width, rate, total // (channels * width), "NONE", None))
            for row in sounds.select("number", "frames").orderBy("number").toLocalIterator():
                out.writeframesraw(row.frames)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
    return total // (channels * width)


def marked_up(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """ord, id, markup of texts (ord, id, text): a note's body stands at its first anchor, references at later ones.

    notes: note_id, body. An anchor without a note gives a null markup.
    """
    # odd parts are ids of anchors, even ones prose
    cut = F.split(F.regexp_replace("text", tx.NARROW_ANCHOR, "\u0000$1\u0000"), "\u0000")
    parts = texts.select("ord", "id", F.posexplode(cut).alias("pos", "part"))
    anchor = F.col("pos") % 2 == 1
    turn = F.row_number().over(Window.partitionBy("part").orderBy("ord", "pos"))
    used = parts.where(anchor).withColumn("_turn", turn).join(notes.withColumnRenamed("note_id", "part"), "part", "left")
    shown = F.when(F.col("body").isNull(), F.lit(None)).when(F.col("_turn") == 1, F.concat(F.lit("#footnote["), tx.escape_markup("body"), F.lit("]<note-"), F.col("part"), F.lit(">"))).otherwise(F.concat(F.lit("#footnote(<note-"), F.col("part"), F.lit(">)")))
    used = used.select("ord", "id", "pos", shown.alias("m"))
    prose = parts.where(~anchor).select("ord", "id", "pos", tx.escape_markup("part").alias("m"))
    rows = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("m", F.lit("")).alias("m"))))
    whole = prose.unionByName(used).groupBy("ord", "id").agg(rows.alias("_r"), F.max(F.col("m").isNull().cast("int")).alias("_lost"))
    return whole.select("ord", "id", F.when(F.col("_lost") == 0, F.array_join(F.transform("_r", lambda x: x.m), "")).alias("markup"))


def unused_notes(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """note_ord, markup of notes (note_id, note_ord, label, body) that no anchor of texts uses, for the end of the book."""
    used = texts.select(F.explode(tx.note_ids("text")).alias("note_id")).distinct()
    return notes.join(used, "note_id", "left_anti").select("note_ord", F.concat(tx.escape_markup("label"), F.lit(". "), tx.escape_markup("body")).alias("markup"))


def image_markup(images: DataFrame) -> DataFrame:
    """images (path, box) with markup."""
    block = F.format_string("#block(width: 100%%, breakable: false, above: 1em, below: 1em)[#align(center)[#image(%s, %s)]]", F.concat(F.lit('"'), "path", F.lit('"')), geo.shown_size(F.col("box")))
    return images.withColumn("markup", block)


def document(parts: DataFrame) -> DataFrame:
    """One row, text: parts (ord, markup) in order, a line break between."""
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "markup"))), lambda x: x.markup), "\n").alias("text"))
