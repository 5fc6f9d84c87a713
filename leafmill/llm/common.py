"""What the corpus operators share: the shared folder, stored tables, ranges of a key.

Intermediate results are cut off with tables in the shared folder that
``spark.checkpoint.dir`` names, never with blocks of one executor, so that the
loss of an executor costs a few tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.shipping import ship

__all__ = ["drop_stored", "partitions", "range_ids", "shared_dir", "ship", "store", "stored_at"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is read from the session. Only a local session may lack it; such a
    session, as in tests, gets a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(sc, "_leafmill_dir", None)
    if own is None:
        own = sc._leafmill_dir = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return own


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the written table."""
    return stored_at(df, f"{shared_dir(df.sparkSession)}/leafmill/{uuid.uuid4().hex}-{name}")


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet at path and returns the written table."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    # nullability is not kept by files; the schema saves a job that would infer it and lets a table be empty
    return df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of tables that store() wrote and that df alone reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = f"{shared_dir(spark)}/leafmill/"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f[: f.index("/", f.index("/leafmill/") + len("/leafmill/"))] for f in df.inputFiles() if "/leafmill/" in f}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split("://")[-1].rstrip("/") in folder:
            path.getFileSystem(conf).delete(path, True)


#: Cuts that stand in a plan; more ranges are cut out of these by a short table.
MOST_CUTS = 1000


def _below(cuts: Column, known: Column, size: int) -> Column:
    """How many of ascending cuts lie below a key: the coarse ones, then those of one block."""
    block = max(1, round(size**0.5))
    coarse = F.filter(cuts, lambda c, i: i % block == 0)
    first = F.greatest(F.size(F.filter(coarse, lambda c: c < known)) - 1, F.lit(0)) * block
    return (first + F.size(F.filter(F.slice(cuts, first + 1, F.lit(block)), lambda c: c < known))).cast("long")


def range_ids(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """df with a long column that rises with key and deals the rows out about evenly.

    The cuts are approximate quantiles, found by an aggregate; rows with the same
    key share a range. Null keys are in range 0. More than MOST_CUTS parts are cut
    in two steps: each range by quantiles of its own, which are a table of MOST_CUTS
    rows with 8 bytes for each part, and broadcast.
    """
    if parts <= 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    first = min(parts, MOST_CUTS)
    quantiles = lambda n: F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)
    cuts = df.agg(quantiles(first).alias("c")).first().c or []
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    known = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    out = df.withColumn(name, _below(F.array(*[F.lit(c) for c in cuts]), known, len(cuts)))
    fine = -(-parts // MOST_CUTS)
    if fine == 1:
        return out
    own = out.groupBy(F.col(name).alias("_coarse")).agg(F.array_sort(F.array_distinct(F.coalesce(quantiles(fine), F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")))).alias("_cuts"))
    own = F.broadcast(store(own, "cuts"))
    out = out.join(own, F.col(name) == F.col("_coarse"))
    return out.withColumn(name, F.col(name) * fine + _below(F.col("_cuts"), known, fine)).drop("_coarse", "_cuts")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
