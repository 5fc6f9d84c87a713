"""Pages to chapters and paragraphs with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import ids
from leafmill.functions import text as tx

SAMPLE_CHARS = 2000


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """book, page_no, ord, type, text of pages (book, page_no, text): each paragraph is a block."""
    return pages.select("book", "page_no", F.posexplode(tx.split_paragraphs("text")).alias("ord", "text")).withColumn("type", F.lit("paragraph"))


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """Headings and paragraphs that are not blank, with heading, chapter_no, opens_page."""
    kept = blocks.where(F.col("type").isin("paragraph", "heading")).withColumn("text", tx.strip("text")).where("text <> ''")
    kept = kept.withColumn("heading", (F.col("type") == "heading") | tx.is_heading("text"))
    book = Window.partitionBy("book").orderBy("page_no", "ord")
    page = Window.partitionBy("book", "page_no").orderBy("ord")
    # text before the first heading opens a chapter without one
    leading = F.when(F.first("heading").over(book), F.lit(0)).otherwise(F.lit(1))
    return kept.withColumns({
        "chapter_no": (F.sum(F.col("heading").cast("int")).over(book) + leading).cast("int"),
        "opens_page": F.row_number().over(page) == 1,
    })


def goes_on(text: Column, before: Column) -> Column:
    """Whether a paragraph that opens a page carries on the one before: it begins small, that one has no end."""
    return F.coalesce(text.rlike(r"^\p{Ll}") & ~before.rlike("[.!?:;][”\"’]?$"), F.lit(False))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """book, chapter_no, number, id, text, source_page, source_pages of each paragraph; page breaks are mended."""
    prose = in_reading_order(blocks).where("not heading").withColumn("text", tx.heading_title("text"))
    chapter = Window.partitionBy("book", "chapter_no").orderBy("page_no", "ord")
    joined = F.col("opens_page") & goes_on(F.col("text"), F.lag("text").over(chapter))
    prose = prose.withColumn("_new", (~joined).cast("int")).withColumn("number", F.sum("_new").over(chapter).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("page_no", "ord", "text")))
    out = prose.groupBy("book", "chapter_no", "number").agg(parts.alias("_p"))
    return out.select(
        "book", "chapter_no", "number",
        ids.paragraph_id(ids.chapter_id(F.col("chapter_no")), F.col("number")).alias("id"),
        F.array_join(F.transform("_p", lambda x: x.text), " ").alias("text"),
        F.col("_p")[0].page_no.alias("source_page"),
        F.array_distinct(F.transform("_p", lambda x: x.page_no)).alias("source_pages"),
    )


def headings(blocks: DataFrame) -> DataFrame:
    """book, chapter_no, id, text, source_page of each chapter's heading; titles that are empty are left out."""
    own = in_reading_order(blocks).where("heading").withColumn("text", tx.heading_title("text")).where("text <> ''")
    return own.select("book", "chapter_no", ids.heading_id(ids.chapter_id(F.col("chapter_no"))).alias("id"), "text", F.col("page_no").alias("source_page"))


def entries(blocks: DataFrame, titles: DataFrame, notes: DataFrame) -> DataFrame:
    """All source entries in book order: book, ord, id, chapter, kind, text.

    titles: book, title; notes: book, note_ord, note_id, text. Order: the title,
    each chapter's heading and paragraphs, the notes.
    """
    of = lambda df, kind, chapter, number: df.select("book", F.lit(kind).alias("kind"), chapter.alias("chapter"), F.struct(number[0].alias("a"), number[1].alias("b"), number[2].alias("c")).alias("_at"), "id", "text")
    one, zero = F.lit(1), F.lit(0)
    chapter = ids.chapter_id(F.col("chapter_no"))
    rows = of(titles.where("title <> ''").select("book", F.lit("book-title").alias("id"), F.col("title").alias("text")), "title", F.lit(None).cast("string"), (zero, zero, zero))
    rows = rows.unionByName(of(headings(blocks), "heading", chapter, (one, F.col("chapter_no"), zero)))
    rows = rows.unionByName(of(paragraphs(blocks), "paragraph", chapter, (one, F.col("chapter_no"), F.col("number"))))
    rows = rows.unionByName(of(notes.withColumn("id", F.col("note_id")), "note", F.lit("footnotes"), (F.lit(2), F.col("note_ord"), zero)))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("book").orderBy("_at"))).drop("_at")


def language_samples(blocks: DataFrame, n: int = SAMPLE_CHARS) -> DataFrame:
    """book, sample_no, sample: prose at the start, middle and end of each book; a short book as a whole."""
    prose = blocks.where("type = 'paragraph'").withColumn("text", tx.strip("text")).where((F.col("text") != "") & ~tx.is_heading("text"))
    # paragraphs are laid end to end, an empty line after each; only what the samples touch is put together
    prose = prose.withColumn("_end", F.sum(F.length("text") + 2).over(Window.partitionBy("book").orderBy("page_no", "ord"))).withColumn("_begin", F.col("_end") - F.length("text") - 2)
    total = prose.groupBy("book").agg((F.max("_end") - 2).alias("_total"))
    starts = F.when(F.col("_total") <= n, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.floor((F.col("_total") - n) / 2), F.col("_total") - n))
    rows = prose.join(total, "book").select("book", "text", "_begin", "_end", "_total", F.posexplode(starts).alias("sample_no", "_from"))
    rows = rows.withColumn("_to", F.least(F.col("_from") + n, "_total")).where("_begin < _to AND _end > _from")
    first = F.greatest(F.col("_from"), "_begin")
    piece = F.substring(F.concat("text", F.lit("\n\n")), (first - F.col("_begin") + 1).cast("int"), (F.least("_to", "_end") - first).cast("int"))
    own = F.sort_array(F.collect_list(F.struct("_begin", piece.alias("t"))))
    return rows.groupBy("book", "sample_no").agg(F.array_join(F.transform(own, lambda x: x.t), "").alias("sample"))


def unanimous(answers: DataFrame, key: str = "book", answer: str = "lang") -> DataFrame:
    """key, lang: the answer that all of a key's rows give, if it is a two-letter code; else `unknown`."""
    valid = F.when(F.col(answer).rlike("^[a-z]{2}$"), F.col(answer)).otherwise(F.lit("unknown"))
    return answers.withColumn("_a", valid).groupBy(key).agg(F.when(F.min("_a") == F.max("_a"), F.max("_a")).otherwise(F.lit("unknown")).alias("lang"))
