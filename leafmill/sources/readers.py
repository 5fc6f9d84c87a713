"""Readers: text with byte order marks, JSON artifacts, WAV headers, glyph tables."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import without_fence

GLYPHS = "book string, page_no int, width double, height double, ord int, text string, x0 double, x1 double, top double, bottom double, size double, note_id string, note_label string, separators array<double>, links string, repeated array<string>"
CHECKPOINTS = "stage string, key string, payload string, ord long"


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 after its byte order mark, else UTF-8, without a mark."""
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return F.regexp_replace(F.when(wide, F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8")), "^﻿", "")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", decoded(F.col("content")).alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file, in folders of any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def json_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each object of the files; each file may be one pretty-printed value."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def glyphs(spark: SparkSession, path: str) -> DataFrame:
    """The glyph table that a PDF decoder wrote; where layout recovery begins."""
    return spark.read.schema(GLYPHS).parquet(path)


def wav_header(data: bytes | None) -> tuple[int, int, int, int] | None:
    """Channels, sample width, rate and frames of a whole WAV file; None for one that is empty, cut off or compressed."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as reader:
            n = reader.getnframes()
            head = (reader.getnchannels(), reader.getsampwidth(), reader.getframerate(), n)
            if n < 1 or reader.getcomptype() != "NONE":
                return None
            reader.setpos(n - 1)
            return head if len(reader.readframes(1)) == head[0] * head[1] else None
    except (wave.Error, EOFError):
        return None


def wav_headers(sounds: DataFrame) -> DataFrame:
    """sounds (content) with the struct wav: channels, sample_width, rate, frames; null if the file is no use."""

    @F.pandas_udf("channels int, sample_width int, rate int, frames long")
    def head(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_header(c) or (None,) * 4 for c in content], columns=["channels", "sample_width", "rate", "frames"])

    wav = head("content")
    return sounds.withColumn("wav", wav).withColumn("wav", F.when(F.col("wav.frames").isNotNull(), F.col("wav")))


def text_maps(replies: DataFrame) -> DataFrame:
    """id, entry, text of replies (id, reply) that are JSON objects of texts without repeated ids; see rejected()."""
    own = replies.select("id", F.try_parse_json(without_fence("reply")).alias("_v"))
    good = own.where(_is_map(F.col("_v")))
    whole = good.select("id", F.from_json(F.to_json("_v"), "map<string,string>").alias("_m"))
    return whole.select("id", F.explode("_m").alias("entry", "text"))


def _is_map(value: Column) -> Column:
    """Whether a variant is an object whose values are all strings."""
    shape = F.schema_of_variant(value)
    return F.coalesce(shape.rlike(r"^OBJECT<(?:[^:<>]+: STRING(?:, )?)*>$"), F.lit(False))


def rejected(replies: DataFrame) -> DataFrame:
    """id, reply of replies that text_maps() cannot use: the dead letters."""
    own = replies.withColumn("_v", F.try_parse_json(without_fence("reply")))
    return own.where(F.col("_v").isNull() | ~_is_map(F.col("_v"))).select("id", "reply")
