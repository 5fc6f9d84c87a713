"""Stages of books: which are to be done, drafts and reviews in one pass, and work that can be stopped and watched."""

from __future__ import annotations

import hashlib
import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from leafmill.operators import memo
from leafmill.sources import writers
from leafmill.streaming import resume

# Stages in order, with the artifacts that a finished one has left; one without any is always done again.
STAGES = (
    ("ingest", ("pages",)),
    ("segment", ("book",)),
    ("stylesheet", ("synopses", "stylesheet")),
    ("translate", ("patches", "draft")),
    ("merge", ("final",)),
    ("typeset", ()),
)
DRAFTED = "stage string, key string, payload string, error string"


def pending(jobs: DataFrame, artifacts: DataFrame, stages: tuple = STAGES) -> DataFrame:
    """job_id, ord, stage: the stages of jobs (job_id) that lack one of their artifacts (job_id, name)."""
    have = artifacts.where(F.col("name").isin(*[x for _, a in stages for x in a])).groupBy("job_id").agg(F.collect_set("name").alias("_have"))
    rows = jobs.select("job_id").distinct().join(have, "job_id", "left")
    plans = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("stage"), F.array(*[F.lit(x) for x in a]).cast("array<string>").alias("needs")) for k, (s, a) in enumerate(stages)])
    each = rows.select("job_id", "_have", F.explode(plans).alias("_s"))
    done = (F.size("_s.needs") > 0) & (F.size(F.array_except("_s.needs", F.coalesce("_have", F.array().cast("array<string>")))) == 0)
    return each.where(~done).select("job_id", "_s.ord", "_s.stage")


def drafted_and_reviewed(items: DataFrame, path: str, drafter: Callable[[], object], reviewer: Callable[[], object], order: int) -> DataFrame:
    """items (key, text) with draft and review; an item is reviewed as soon as it is drafted, in the same task.

    Nothing waits for all drafts: a worker makes one call at a time, so that the
    number of partitions bounds both kinds together. A review's key takes in the
    draft that it read. What is done is kept; a draft stays when its review fails,
    and a later run asks for the review only. Equal keys are worked on once.
    """
    spark = items.sparkSession
    known = memo.current(resume.checkpoints(spark, path))
    drafts = known.where("stage = 'draft'").select("key", F.col("payload").alias("_draft"))
    reviews = known.where("stage = 'review'").select(F.col("key").alias("_review_key"), F.lit(True).alias("_reviewed"))
    own = items.groupBy("key").agg(F.first("text").alias("text")).join(drafts, "key", "left").withColumn("_review_key", review_key("key", "_draft"))
    left = own.join(reviews, "_review_key", "left").where("_reviewed is null").select("key", "text", "_draft")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draft_client, review_client = drafter(), reviewer()
        for batch in batches:
            out = []
            for key, text, draft in zip(batch["key"], batch["text"], batch["_draft"]):
                stage, own_key = "draft", key
                try:
                    if not isinstance(draft, str):
                        draft = draft_client.call({"text": text})
                        out.append(("draft", key, draft, None))
                    stage, own_key = "review", _review_key(key, draft)
                    out.append(("review", own_key, review_client.call({"text": text, "draft": draft}), None))
                except RuntimeError as e:
                    out.append((stage, own_key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["stage", "key", "payload", "error"])

    found = left.mapInPandas(run, DRAFTED).where("payload is not null")
    writers.append_checkpoints(found.withColumn("ord", F.lit(order).cast("long")), path)
    now = memo.current(resume.checkpoints(spark, path))
    out = items.join(now.where("stage = 'draft'").select("key", F.col("payload").alias("draft")), "key", "left").withColumn("_review_key", review_key("key", "draft"))
    return out.join(now.where("stage = 'review'").select(F.col("key").alias("_review_key"), F.col("payload").alias("review")), "_review_key", "left").drop("_review_key")


def review_key(key: str, draft: str):  # noqa: ANN201
    """The key of a review, as _review_key; null without a draft."""
    return F.concat(F.col(key), F.lit("-"), F.substring(F.sha2(draft, 256), 1, 24))


def _review_key(key: str, draft: str) -> str:
    return f"{key}-{hashlib.sha256(draft.encode()).hexdigest()[:24]}"


class Stopped(RuntimeError):
    """The work was cancelled."""


class Gate:
    """Where work may be paused and cancelled: between stages it waits here, and running Spark jobs are interrupted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._go, self._stop = threading.Event(), threading.Event()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        self._stop.set()
        self._go.set()
        self.spark.sparkContext.cancelJobGroup(self.name)

    def run(self, stages: dict[str, Callable[[], object]], report: Callable[[str, int, int], None] = lambda *_: None) -> dict[str, object]:
        """The results of stages in their order; report(stage, done, total) before and after each."""
        out = {}
        for name, stage in stages.items():
            self._go.wait()
            if self._stop.is_set():
                raise Stopped(self.name)
            self.spark.sparkContext.setJobGroup(self.name, name, interruptOnCancel=True)
            report(name, 0, 1)
            try:
                out[name] = stage()
            except Exception:
                if self._stop.is_set():
                    raise Stopped(self.name) from None
                raise
            finally:
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            report(name, 1, 1)
        return out


class Progress(StreamingQueryListener):
    """Puts (query, batch, rows) of each batch of a stream, and (query, None, error) of its end, into a queue."""

    def __init__(self, events: queue.Queue):
        super().__init__()
        self.events = events

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.events.put((event.name, "started", 0))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.events.put((event.progress.name, event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.events.put((str(event.id), None, event.exception))
