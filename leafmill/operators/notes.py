"""Notes: bodies that go on over pages, anchors, and who reads a note first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import ids
from leafmill.functions import text as tx


def with_last_note(continuations: DataFrame, notes: DataFrame) -> DataFrame:
    """continuations (book, page_no, ord, note_id, text), whose null note_id becomes that of the last note on an earlier page.

    notes: book, page_no, ord, note_id. Notes of the same page do not count; null
    stays where no note came before.
    """
    own = continuations.select("book", "page_no", "ord", F.lit(0).alias("_note"), "note_id", "text")
    all_rows = own.unionByName(notes.select("book", "page_no", "ord", F.lit(1).alias("_note"), "note_id", F.lit(None).cast("string").alias("text")))
    before = Window.partitionBy("book").orderBy("page_no", "_note", "ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_note") == 1, F.col("note_id")), ignorenulls=True).over(before)
    return all_rows.withColumn("note_id", F.coalesce("note_id", last)).where("_note = 0").drop("_note")


def orphans(continuations: DataFrame, notes: DataFrame) -> DataFrame:
    """Continuations of notes that do not exist."""
    return continuations.join(notes.select("book", "note_id"), ["book", "note_id"], "left_anti")


def whole_bodies(notes: DataFrame, continuations: DataFrame) -> DataFrame:
    """notes (book, note_id, source_page, text) with what goes on on later pages, and source_pages."""
    parts = F.sort_array(F.collect_list(F.struct("page_no", "ord", "text")))
    more = continuations.groupBy("book", "note_id").agg(parts.alias("_more"))
    out = notes.join(more, ["book", "note_id"], "left")
    texts = F.concat(F.array(F.regexp_replace("text", r"(?U)\s+$", "")), F.coalesce(F.transform("_more", lambda x: tx.strip(x.text)), F.array().cast("array<string>")))
    pages = F.concat(F.array("source_page"), F.coalesce(F.transform("_more", lambda x: x.page_no), F.array().cast("array<int>")))
    whole = F.when(F.col("_more").isNull(), F.col("text")).otherwise(tx.join_hyphenated(texts))
    return out.withColumns({"text": whole, "source_pages": F.array_distinct(pages)}).drop("_more")


def numbered(notes: DataFrame) -> DataFrame:
    """notes (page_no, top, x0) with note_id: their places on the page, from above, then from the left."""
    place = F.row_number().over(Window.partitionBy("page_no").orderBy("top", "x0"))
    return notes.withColumn("note_id", ids.note_id(F.col("page_no"), place))


def references(texts: DataFrame, wide: bool = False) -> DataFrame:
    """ord, id, pos, note_id, first: every anchor of texts (ord, id, text); first: no anchor of that note came before."""
    used = texts.select("ord", "id", F.posexplode(tx.note_ids("text", wide)).alias("pos", "note_id"))
    return used.withColumn("first", F.row_number().over(Window.partitionBy("note_id").orderBy("ord", "pos")) == 1)


def readers(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """ord, id, turn, note_id: which notes (note_id, note_ord) are read after which text, each once, in the notes' order."""
    first = references(texts, wide=True).where("first").join(notes.select("note_id", "note_ord"), "note_id")
    turn = F.row_number().over(Window.partitionBy("ord").orderBy("note_ord"))
    return first.select("ord", "id", turn.alias("turn"), "note_id")


def unanchored(notes: DataFrame, texts: DataFrame, chapter_pages: DataFrame) -> DataFrame:
    """note_id, chapter_no: notes (note_id, source_page) without an anchor in texts, by the first chapter on their page.

    chapter_pages: chapter_no, page_no. A note on no chapter's page goes to the last chapter.
    """
    used = references(texts, wide=True).select("note_id").distinct()
    free = notes.join(used, "note_id", "left_anti")
    owner = chapter_pages.groupBy(F.col("page_no").alias("source_page")).agg(F.min("chapter_no").alias("_own"))
    last = F.broadcast(chapter_pages.agg(F.max("chapter_no").alias("_last")).withColumn("_one", F.lit(1)))
    out = free.join(owner, "source_page", "left").withColumn("_one", F.lit(1)).join(last, "_one")
    return out.select("note_id", F.coalesce("_own", "_last").alias("chapter_no"))
