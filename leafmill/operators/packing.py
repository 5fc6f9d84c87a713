"""Paragraphs packed into chunks of whole paragraphs, with the words around each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import ids
from leafmill.functions import text as tx
from leafmill.operators.folds import fold

CHUNK_WORDS, PROFILE_WORDS, CONTEXT_WORDS = 1200, 6000, 400


def pack(paragraphs: DataFrame, max_words: int, key: str = "chapter", order: str = "ord", words: str = "words") -> DataFrame:
    """paragraphs with chunk: its number within the key, from 0, filled in order.

    A chunk that is not empty ends before a paragraph that would take it beyond
    max_words; a longer paragraph is alone.
    """
    if max_words < 1:
        raise ValueError("a chunk holds one word at least")

    def step(state: tuple[int, int], n: int) -> tuple[tuple[int, int], int]:
        chunk, held = state
        if held >= 0 and held + n > max_words:
            chunk, held = chunk + 1, -1
        return (chunk, max(held, 0) + n), chunk

    return fold(paragraphs, [key], [order], [words], "chunk", "int", lambda: (0, -1), step)


def chunk_texts(packed: DataFrame, key: str = "chapter", order: str = "ord", between: str = "\n\n") -> DataFrame:
    """A row for each chunk: key, chunk, chunk_key, n_paragraphs, words, text."""
    own = F.sort_array(F.collect_list(F.struct(order, "text")))
    rows = packed.groupBy(key, "chunk").agg(F.count("*").alias("n_paragraphs"), F.sum("words").alias("words"), F.array_join(F.transform(own, lambda x: x.text), between).alias("text"))
    return rows.withColumn("chunk_key", ids.chunk_key(F.col(key), F.col("chunk")))


def with_context(chunks: DataFrame, key: str = "chapter", n_words: int = CONTEXT_WORDS) -> DataFrame:
    """chunks with context_before and context_after: the nearest words of the chunks around, within the key."""
    w = Window.partitionBy(key).orderBy("chunk")
    return chunks.withColumns({
        "context_before": F.coalesce(tx.edge_words(F.lag("text").over(w), n_words, last=True), F.lit("")),
        "context_after": F.coalesce(tx.edge_words(F.lead("text").over(w), n_words), F.lit("")),
    })


def book_paragraphs(entries: DataFrame) -> DataFrame:
    """Source entries (ord, id, chapter, kind, text) as paragraphs to pack, with words.

    The title goes with the first chapter, or with chapter `front` if there is
    none; headings are paragraphs; notes are packed by themselves.
    """
    first = entries.where("kind in ('heading', 'paragraph')").agg(F.min_by("chapter", "ord").alias("_first"))
    own = entries.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one")
    chapter = F.when(F.col("kind") == "note", F.lit("footnotes")).when(F.col("kind") == "title", F.coalesce("_first", F.lit("front"))).otherwise(F.col("chapter"))
    return own.withColumn("chapter", chapter).withColumn("words", tx.word_count("text")).drop("_first", "_one")


def book_chunks(entries: DataFrame, max_words: int = CHUNK_WORDS) -> DataFrame:
    """The chunks of a whole book, with context; kind is prose or footnotes."""
    chunks = with_context(chunk_texts(pack(book_paragraphs(entries), max_words)))
    return chunks.withColumn("kind", F.when(F.col("chapter") == "footnotes", F.lit("footnotes")).otherwise(F.lit("prose")))


def around(chunks: DataFrame, synopses: DataFrame) -> DataFrame:
    """chunks (chapter_ord) with the synopses (chapter_ord, synopsis) of the chapters before, at and after theirs."""
    near = chunks.select(F.col("chapter_ord").alias("_at")).distinct().select("_at", F.explode(F.array(*[F.col("_at") + k for k in (-1, 0, 1)])).alias("chapter_ord"))
    own = near.join(synopses, "chapter_ord").groupBy("_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter_ord", "synopsis"))), lambda x: x.synopsis), "\n").alias("synopses"))
    return chunks.join(own, chunks.chapter_ord == own._at, "left").drop("_at")
