"""How each page is read: from its own text, by transcription, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions import text as tx

# Least signs of a page with text of its own, most signs and least share of a partial scan.
TEXT_CHARS, PARTIAL_CHARS, PARTIAL_SHARE = 50, 1000, 0.35


def classified(pages: DataFrame) -> DataFrame:
    """pages (page_no, text, page_width, page_height, images: array of role, box) with full_scan, partial_scan."""
    page = F.col("page_width") * F.col("page_height")
    full = F.exists("images", lambda i: i.role == "scan_background")
    large = F.exists("images", lambda i: geo.area(i.box) >= page * PARTIAL_SHARE)
    return pages.withColumns({"full_scan": full, "partial_scan": (F.length(tx.strip("text")) <= PARTIAL_CHARS) & large})


def routes(pages: DataFrame, narration: bool = False) -> DataFrame:
    """classified pages with route: native, transcribe, blank or cover.

    narration: pages also have visible_chars and body_chars, the signs of the page
    and of its body. There, body text is enough, and a page without any signs is
    blank, or the cover if it is the first and has images; the cover is transcribed
    only if other pages are, or if it is alone.
    """
    scanned = F.col("full_scan") | F.col("partial_scan")
    native = (F.length(tx.strip("text")) >= TEXT_CHARS) & ~scanned
    if not narration:
        return pages.withColumn("route", F.when(native, F.lit("native")).otherwise(F.lit("transcribe")))
    spoken = (F.col("visible_chars") > 0) & ((F.col("body_chars") >= TEXT_CHARS) | ~scanned)
    bare = F.col("visible_chars") == 0
    first = F.when(bare & (F.col("page_no") == 1) & (F.size("images") > 0), F.lit("cover")).when(bare & (F.size("images") == 0), F.lit("blank"))
    own = pages.withColumn("route", F.coalesce(first, F.when(spoken | native, F.lit("native")).otherwise(F.lit("transcribe"))))
    need = F.broadcast(own.agg(F.max(((F.col("route") == "transcribe") & (F.col("page_no") > 1)).cast("int")).alias("_other"), F.count("*").alias("_n")).withColumn("_one", F.lit(1)))
    whole = own.withColumn("_one", F.lit(1)).join(need, "_one")
    alone = (F.col("route") == "cover") & ((F.col("_other") == 1) | (F.col("_n") == 1))
    return whole.withColumn("route", F.when(alone, F.lit("transcribe")).otherwise(F.col("route"))).drop("_one", "_other", "_n")


def with_backgrounds(pages: DataFrame) -> DataFrame:
    """pages whose large images on partial scans have the role of backgrounds."""
    page = F.col("page_width") * F.col("page_height")
    turned = F.transform("images", lambda i: i.withField("role", F.when(F.col("partial_scan") & (geo.area(i.box) >= page * PARTIAL_SHARE), F.lit("scan_background")).otherwise(i.role)))
    return pages.withColumn("images", turned)
