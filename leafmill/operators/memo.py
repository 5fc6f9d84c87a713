"""Work that is not done twice: results kept by the fingerprint of what they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKPOINT = "stage string, key string, payload string, ord long"


def current(checkpoints: DataFrame) -> DataFrame:
    """stage, key, payload: of the results saved under a key, the last."""
    return checkpoints.groupBy("stage", "key").agg(F.max_by("payload", "ord").alias("payload"))


def kept(items: DataFrame, checkpoints: DataFrame, valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """items (stage, key, ...) that have a result, with payload; valid keeps the rows whose result still holds."""
    rows = items.join(current(checkpoints), ["stage", "key"])
    return valid(rows) if valid else rows


def todo(items: DataFrame, done: DataFrame) -> DataFrame:
    """items without a result."""
    return items.join(done.select("stage", "key"), ["stage", "key"], "left_anti")


def once(items: DataFrame) -> DataFrame:
    """items with equal (stage, key) as one row, with multiplicity: that many wait for the result."""
    others = [c for c in items.columns if c not in ("stage", "key")]
    return items.groupBy("stage", "key").agg(F.first(F.struct(*others)).alias("_r") if others else F.lit(None).alias("_r"), F.count("*").alias("multiplicity")).select("stage", "key", *(["_r.*"] if others else []), "multiplicity")


def completed(items: DataFrame, waiting: DataFrame) -> DataFrame:
    """One row, done and total: items are done unless they wait, each as many times as its multiplicity."""
    total = items.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    left = waiting.agg(F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("_left")).withColumn("_one", F.lit(1))
    return total.join(F.broadcast(left), "_one").select((F.col("total") - F.col("_left")).alias("done"), "total")


def in_scope(checkpoints: DataFrame, fingerprints: DataFrame, signatures: DataFrame) -> DataFrame:
    """checkpoints (scope, ...) whose scope's saved fingerprint (scope, signature) is still its signature."""
    same = fingerprints.join(signatures, ["scope", "signature"], "left_semi")
    return checkpoints.join(F.broadcast(same.select("scope")), "scope", "left_semi")


def ready_jobs(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """jobs (job_id, ...) that have both the artifacts `book` and `final`."""
    have = artifacts.where(F.col("name").isin("book", "final")).groupBy("job_id").agg(F.countDistinct("name").alias("n")).where("n = 2")
    return jobs.join(have.select("job_id"), "job_id", "left_semi")


def unfinished_jobs(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """jobs (job_id, status) that run and have a source: a PDF, an imported text, or a saved pair of artifacts."""
    sources = artifacts.where(F.col("name").isin("source_pdf", "text_import")).select("job_id").unionByName(ready_jobs(jobs, artifacts).select("job_id")).distinct()
    return jobs.where("status = 'running'").join(sources, "job_id", "left_semi")


def imported(files: DataFrame) -> DataFrame:
    """job_id, path, content of files (path, content): equal contents are one job, under the first path."""
    own = files.withColumn("job_id", F.sha1("content"))
    return own.groupBy("job_id").agg(F.min_by(F.struct("path", "content"), "path").alias("_f")).select("job_id", "_f.path", "_f.content")


def code_fingerprint(files: DataFrame) -> DataFrame:
    """One row, fingerprint: sha256 over each file's path and sha256 (path, content), in order of the paths, a line each."""
    part = F.concat(F.col("path"), F.lit("\n"), F.sha2("content", 256), F.lit("\n"))
    rows = files.select("path", part.alias("h"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "h"))), lambda x: x.h), "").cast("binary"), 256).alias("fingerprint"))


def paired_source(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """job_id, path: the readable file that goes with jobs (job_id, output, kind): the output, or the copy of an imported PDF.

    artifacts: job_id, name, path, kind; the kind that the sound's own artifact
    notes is believed before the job's. Null where there is none.
    """
    noted = artifacts.where("name = 'audio_source'").groupBy("job_id").agg(F.max("kind").alias("_noted"))
    copies = artifacts.where("name = 'source_pdf'").groupBy("job_id").agg(F.min("path").alias("_copy"))
    rows = jobs.join(noted, "job_id", "left").join(copies, "job_id", "left")
    kind = F.coalesce("_noted", "kind")
    return rows.select("job_id", F.coalesce(F.nullif("output", F.lit("")), F.when(kind == "czech_pdf", F.col("_copy"))).alias("path"))
