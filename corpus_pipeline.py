"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Where a column is null, a table empty or a row repeated,
what the stage's operator says of it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import near, packing, quality, substrings
from leafmill.llm.common import drop_stored, store

#: Near-duplicates share PERCENT of a hundred of their runs of WORDS words.
WORDS, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted to the labels that are not held out, predicts to be good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "_score").where(quality.predicted("_score") == 1).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; the others go."""
    found = near.near_duplicates(docs, WORDS, PERCENT)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller doc_id holds; a text that loses nothing stays as it is."""
    found = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": text, "n_chars": n_chars}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 ids."""
    import public_tokenizers

    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    lean = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "rank")
    return packing.pack(lean).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("best-fit packing", packed),
]

#: Tree growing, signatures and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's table is kept until the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
