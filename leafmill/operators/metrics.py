"""Figures on runs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

# How much of a run each stage is.
STAGE_WEIGHTS = {"ingest": 10, "segment": 2, "stylesheet": 10, "translate": 70, "merge": 2, "typeset": 6}


def request_summary(requests: DataFrame) -> DataFrame:
    """stage, calls, failed_attempts (null if a status is missing), median, p95 (nearest rank), max and total seconds."""
    failed = F.when(F.count("status") == F.count("*"), F.sum((F.col("status") == "failed").cast("int")))
    return requests.groupBy("stage").agg(
        F.count("*").alias("calls"),
        failed.alias("failed_attempts"),
        F.round(F.median("seconds"), 3).alias("median_seconds"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.round(F.sum("seconds"), 3).alias("total_seconds"),
    )


def peak_concurrency(requests: DataFrame, key: str | None = None) -> DataFrame:
    """The most requests (started, ended) that ran at once, by key; one that ends as another starts is over.

    Moments are summed up first, and moments of equal spans of time by themselves,
    so that no task sees all of them.
    """
    by = [key] if key else []
    steps = requests.select(*by, F.col("started").alias("at"), F.lit(1).alias("step")).unionByName(requests.select(*by, F.col("ended").alias("at"), F.lit(-1).alias("step")))
    moments = steps.groupBy(*by, "at").agg(F.sum("step").alias("net"))
    span = F.floor(F.unix_timestamp("at") / 3600) if dict(moments.dtypes)["at"] == "timestamp" else F.floor(F.col("at") / 3600)
    moments = moments.withColumn("_span", span)
    spans = moments.groupBy(*by, "_span").agg(F.sum("net").alias("_net"))
    before = spans.withColumn("_before", F.sum("_net").over(Window.partitionBy(*by).orderBy("_span")) - F.col("_net")).drop("_net")
    running = F.sum("net").over(Window.partitionBy(*by, "_span").orderBy("at"))
    found = moments.withColumn("_running", running).join(before, [*by, "_span"])
    return found.groupBy(*by).agg(F.max(F.col("_before") + F.col("_running")).alias("peak"))


def progress(events: DataFrame, weights: dict[str, int] = STAGE_WEIGHTS) -> DataFrame:
    """key, progress: the weighted mean of each stage's furthest fraction; events: key, stage, done, total."""
    far = events.groupBy("key", "stage").agg(F.max(F.least(F.lit(1.0), F.col("done") / F.greatest(F.col("total"), F.lit(1)))).alias("_f"))
    weight = F.coalesce(*[F.when(F.col("stage") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    return far.groupBy("key").agg((F.sum(weight * F.col("_f")) / float(sum(weights.values()))).alias("progress"))


def source_statistics(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """Paragraphs, words and signs by key."""
    return paragraphs.groupBy(*keys).agg(F.count("*").alias("n_paragraphs"), F.sum(tx.word_count("text")).alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


def extraction_report(pages: DataFrame) -> DataFrame:
    """book, source_pages, footnotes, images, warnings of pages (footnotes, images, warnings: arrays)."""
    warnings = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "warnings"))), lambda x: x.warnings))
    return pages.groupBy("book").agg(F.count("*").alias("source_pages"), F.sum(F.size("footnotes")).alias("footnotes"), F.sum(F.size("images")).alias("images"), warnings.alias("warnings"))


def repeated_margins(lines: DataFrame) -> DataFrame:
    """book, key: margin lines (book, page_no, region, text) that come back on enough pages.

    A key counts once a page; it must be on 3 pages and 15 % of the book's pages at
    least. Empty, long and purely numeric lines do not count, nor do footer lines
    that look like notes.
    """
    note = (F.col("region") == "footer") & F.col("text").rlike(r"^\s*(?:\d{1,3}|[*†‡§]+)[.)]?\s*\D")
    keyed = lines.where(~note).select("book", "page_no", tx.margin_key("text").alias("key"))
    # the keys are sifted after they are counted: a filter on them would be pushed down and fold each line again
    counts = keyed.groupBy("book", "key").agg(F.countDistinct("page_no").alias("n"), F.max("key").alias("_k"))
    counts = counts.where("_k <> '' and _k <> '#' and length(_k) <= 120")
    pages = lines.groupBy("book").agg(F.countDistinct("page_no").alias("pages"))
    return counts.join(pages, "book").where("n >= greatest(3, pages * 0.15D)").select("book", "key", "n")


def body_sizes(glyphs: DataFrame, *keys: str) -> DataFrame:
    """keys, body_size: the commonest rounded size of glyphs (keys, ord, text, size) that show; of equal ones the first seen."""
    shown = glyphs.where(tx.strip("text") != "").withColumn("_s", F.bround("size", 1))
    counts = shown.groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by("_s", F.struct("_n", -F.col("_first"))).alias("body_size"))


def leading(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, leading, left_margin of lines (keys, ord, baseline, x0, body_size): median steps between lines, and left edges.

    Steps count that go down by less than two lines; without any, 1.3 of the size.
    """
    step = F.col("baseline") - F.lag("baseline").over(Window.partitionBy(*keys).orderBy("ord"))
    own = lines.withColumn("_step", step).withColumn("_step", F.when((F.col("_step") > 0) & (F.col("_step") < 2 * F.col("body_size")), F.col("_step")))
    return own.groupBy(*keys).agg(F.coalesce(F.median("_step"), F.max("body_size") * 1.3).alias("leading"), F.median("x0").alias("left_margin"))
