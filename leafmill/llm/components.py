"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import drop_stored, store

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, root for each end of edges (a, b: long): root is the smallest node of its component.

    Rounds of large and small stars: each node hands its larger, then its other,
    neighbours on to its smallest one. Every round is an aggregate and a join for
    each kind of star; the number of rounds grows as the logarithm of the longest
    path at most. Nodes without an edge to another node get a row if they have an
    edge to themselves.
    """
    own = store(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    alone = own.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now = own.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    for _ in range(MOST_ROUNDS):
        now = store(_small(_large(now)), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None:
            drop_stored(before[0])
        if before is not None and before[1] == state:
            break
        before = (now, state)
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # a root has no edge of its own in the stars
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).unionByName(alone.join(stars.select("node"), "node", "left_anti").join(now.select(F.col("v").alias("node")).distinct(), "node", "left_anti"))


def _large(edges: DataFrame) -> DataFrame:
    """edges: u > v. Each node's larger neighbours, with the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # with u < v the pair (v, m) takes the place of (u, v)
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
    return up.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges: u > v. Each node and its smaller neighbours, with the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
