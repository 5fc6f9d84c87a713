"""Queries on files and on what goes into a book: decoding, sounds, images, style sheets, checks of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import contracts, evidence, memo, notes, placement
from leafmill.plans.texts import _ANCHORED, _anchored, _notes, documents, longs, md5, table
from leafmill.sources import readers, writers


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in UTF-8, with and without a byte order mark, and in UTF-16 of both orders, read back."""
    kind = F.col("doc_id") % 4
    marked = F.concat(F.lit("﻿"), "text")
    content = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode(marked, "UTF-8")).when(kind == 2, F.encode(marked, "UTF-16BE")).otherwise(F.encode(marked, "UTF-16LE"))
    return documents(spark, sf_dir).select("doc_id", content.alias("content")).select("doc_id", md5(readers.decoded(F.col("content"))).alias("text"))


def sound_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as WAV files, and what their headers say; some files are cut off, and some are empty."""
    key = F.col("p_partkey")
    width = (key % 3 + 1).cast("int")
    sounds = table(spark, sf_dir, "part").select(key.alias("id"), F.repeat(F.lit("x"), (F.col("p_size") * 2 * width).cast("int")).cast("binary").alias("frames"), (F.col("p_size") * 100 + 8000).cast("int").alias("sample_rate"), F.lit(2).alias("channels"), width.alias("sample_width"))
    whole = writers.with_wav(sounds)
    content = F.when(F.col("id") % 7 == 3, F.substring("content", F.lit(1), F.octet_length("content") - 1)).when(F.col("id") % 7 == 5, F.lit(b"")).otherwise(F.col("content"))
    found = readers.wav_headers(whole.select("id", content.alias("content")))
    return longs(found.select("id", *[F.col(f"wav.{c}").alias(c) for c in ("channels", "sample_width", "rate", "frames")]))


SOUND_HEADERS = """
WITH own AS (SELECT p_partkey AS id, p_partkey % 7 NOT IN (3, 5) AS good, CAST(p_partkey % 3 + 1 AS BIGINT) AS width, CAST(p_size AS BIGINT) AS size FROM part)
SELECT id, CASE WHEN good THEN 2 END AS channels, CASE WHEN good THEN width END AS sample_width, CASE WHEN good THEN size * 100 + 8000 END AS rate, CASE WHEN good THEN size END AS frames FROM own"""


def shown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type") == "error", F.lit("scan_background")).when(F.col("event_type") == "signup", F.lit("cover_artwork")).otherwise(F.lit("illustration"))
    return placement.shown_images(table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("ord"), role.alias("role")))


SHOWN_IMAGES = "SELECT user_id AS image_id, min(event_id) AS ord FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1"


def unanchored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of which none has an anchor in the texts, by the chapter on whose page they are."""
    own = spark.range(200).select(F.format_string("fn-p%04d-000", F.col("id").cast("int")).alias("note_id"), (F.col("id") % 60).cast("int").alias("source_page"))
    chapters = spark.range(40).select(F.floor(F.col("id") / 5).cast("int").alias("chapter_no"), (F.col("id") - F.floor(F.col("id") / 10)).cast("int").alias("page_no"))
    return longs(notes.unanchored(own, _anchored(spark, sf_dir), chapters))


UNANCHORED_NOTES = f"""
WITH {_ANCHORED},
own AS (SELECT printf('fn-p%04d-000', range) AS note_id, range % 60 AS page FROM range(200)),
chapters AS (SELECT range // 5 AS chapter_no, range - range // 10 AS page FROM range(40))
SELECT note_id, coalesce((SELECT min(chapter_no) FROM chapters c WHERE c.page = own.page), (SELECT max(chapter_no) FROM chapters)) AS chapter_no
FROM own WHERE note_id NOT IN (SELECT note_id FROM used)"""


def source_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored texts as entries, of which some have the id of another or are blank."""
    own = _anchored(spark, sf_dir).select(F.when(F.col("ord") % 10 == 3, F.col("ord") - 1).otherwise(F.col("ord")).cast("string").alias("id"), F.when(F.col("ord") % 11 == 4, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    return contracts.source_violations(own, _notes(spark))


SOURCE_VIOLATIONS = rf"""
WITH {_ANCHORED},
own AS (SELECT CAST(CASE WHEN ord % 10 = 3 THEN ord - 1 ELSE ord END AS VARCHAR) AS id, CASE WHEN ord % 11 = 4 THEN ' ' ELSE text END AS text FROM anchored),
refs AS (SELECT id, unnest(regexp_extract_all(text, '\[\[FN:([^\]\s]+)\]\]', 1)) AS note_id FROM own)
SELECT id, 'duplicate' AS problem FROM own GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'blank' FROM own WHERE trim(text) = ''
UNION ALL SELECT DISTINCT id, 'unresolved' FROM refs WHERE note_id NOT IN (SELECT note_id FROM notes)"""


def style_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, customers = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    glossary = parts.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("term"), F.col("p_type").alias("czech"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit("")).alias("note"))
    register = customers.select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("pair"), F.lit("ty").alias("form"), F.lit(None).cast("string").alias("note"))
    return evidence.stylesheet(glossary, register, "calm").select(md5("text").alias("text"))


STYLE_SHEET = """
WITH first AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
names AS (SELECT string_agg('- ' || p.p_name || ' → ' || p.p_type || CASE WHEN p.p_partkey % 3 = 0 THEN ' — ' || p.p_brand ELSE '' END, chr(10) ORDER BY p.p_partkey) AS t FROM part p JOIN first ON p.p_partkey = k),
pairs AS (SELECT string_agg('- ' || c_name || ': ty', chr(10) ORDER BY c_custkey) AS t FROM customer)
SELECT md5('# Stylesheet překladu' || chr(10) || chr(10) || '## Vypravěč a styl' || chr(10) || 'calm' || chr(10) || chr(10) || '## Jména, místa a skloňování' || chr(10) || names.t || chr(10) || chr(10) || '## Oslovení (ty/vy)' || chr(10) || pairs.t || chr(10)) AS text
FROM names, pairs"""


def code_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo.code_fingerprint(documents(spark, sf_dir).select(F.format_string("%08d", "doc_id").alias("path"), F.col("text").cast("binary").alias("content")))


CODE_FINGERPRINT = "SELECT sha256(string_agg(printf('%08d', doc_id) || chr(10) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS fingerprint FROM documents"


_queries = dict(
    decoded_texts=(decoded_texts, "SELECT doc_id, md5(text) AS text FROM documents"),
    sound_headers=(sound_headers, SOUND_HEADERS),
    shown_images=(shown_images, SHOWN_IMAGES),
    unanchored_notes=(unanchored_notes, UNANCHORED_NOTES),
    source_violations=(source_violations, SOURCE_VIOLATIONS),
    style_sheet=(style_sheet, STYLE_SHEET),
    code_fingerprint=(code_fingerprint, CODE_FINGERPRINT),
)
QUERIES = {k: q for k, (q, _) in _queries.items()}
ORACLES = {k: s for k, (_, s) in _queries.items() if s}
