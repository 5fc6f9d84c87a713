"""Resumable work: what is done is kept by key, the rest is done, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import memo
from leafmill.sources import readers, writers


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The results stored so far; none if there is no table yet."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], readers.CHECKPOINTS)
    return spark.read.schema(readers.CHECKPOINTS).parquet(path)


def run(items: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], order: int, valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """items (stage, key, text) with payload; only what has no valid result is worked on, equal keys once.

    work: (key, text) to (key, payload, status, ...). Failed rows are not stored, so
    that a later run tries them again; order tells later runs from earlier ones.
    """
    spark = items.sparkSession
    done = memo.kept(items.select("stage", "key").distinct(), checkpoints(spark, path), valid)
    left = memo.once(memo.todo(items, done))
    found = work(left.select("key", "text")).where("status = 'success'").join(left.select("stage", "key"), "key")
    writers.append_checkpoints(found.select("stage", "key", "payload", F.lit(order).cast("long").alias("ord")), path)
    return items.join(memo.current(checkpoints(spark, path)), ["stage", "key"], "left")


def stream(items: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """run() on each batch of a stream of items; a batch that is delivered again finds its results stored."""

    def batch(rows: DataFrame, number: int) -> None:
        run(rows, path, work, number).write.format("noop").mode("overwrite").save()

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
