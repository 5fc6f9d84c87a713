"""Approximate nearest neighbours by inner product: inverted lists of product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted to a bounded sample;
every vector is indexed. A query's asymmetric distance tables give approximate
scores of all vectors in the lists it probes; the best of each list are scored
again, exactly, from their own components. How many lists to probe is found on
the sample: as many as its own neighbours' recall needs.

Equal vectors are one entry of the index, with the smallest ids that hold it, so
that a vector that many rows share is neither searched nor answered more than
once. A list is searched in blocks, and a block's queries in groups, of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ship, store

#: The sample that the index is fitted to: the rows with the smallest hash of their id, LIST_SAMPLE for each list, SAMPLE at least.
SAMPLE, LIST_SAMPLE, SAMPLE_QUERIES, RECALL = 20_000, 32, 400, 0.975
#: There is a list for every four roots of the number of rows, so that lists and vectors in a list grow alike, up to MOST_LISTS.
PARTS, CODES, MOST_LISTS, ROUNDS = 16, 256, 8192, 8
#: Numbers of a matrix of distances that are held at once.
HELD = 4 << 20
#: Vectors in a block of a list, queries in a group. Of a block, as many vectors as RESCORED are scored exactly for a
#: query, and all whose approximate score is within MARGIN standard errors of the last of these.
BLOCK, GROUP, RESCORED, MARGIN = 8192, 512, 64, 2.0
EVERY, NEAREST = 20, 20


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids; an empty cluster keeps its own. With fewer vectors than k, these and repeats of them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.permutation(len(x))[:k]] if len(x) >= k else x[np.arange(k) % len(x)]
    centres = centres.copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    lengths, step = (centres**2).sum(1)[None], max(1, HELD // len(centres))
    parts = [np.argmin(lengths - 2 * x[a : a + step] @ centres.T, axis=1) for a in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lists_for(rows: int) -> int:
    return int(min(MOST_LISTS, max(1, round(rows**0.5 / 4))))


@dataclass
class Index:
    """centres: lists x dimensions; books: parts x CODES x dimensions of a part (zeros fill the last).

    error: standard error of an approximate score, for a query of length 1.
    """

    centres: np.ndarray
    books: np.ndarray
    probes: int
    error: float = 0.0

    def split(self, x: np.ndarray) -> np.ndarray:
        """x as vectors x parts x dimensions of a part."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and the codes of its residual."""
        own = nearest(x, self.centres)
        rest = self.split(x - self.centres[own])
        return own, np.column_stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))]).astype(np.uint8)

    def probe(self, queries: np.ndarray) -> np.ndarray:
        step = max(1, HELD // len(self.centres))
        parts = [np.argsort(-(queries[a : a + step] @ self.centres.T), axis=1, kind="stable")[:, : self.probes] for a in range(0, len(queries), step)]
        return np.concatenate(parts)

    def approximate(self, queries: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Scores of the vectors of list own, by tables of queries x parts x CODES."""
        tables = np.einsum("qmw,mcw->mqc", self.split(queries), self.books)
        out = np.repeat((queries @ self.centres[own])[:, None], len(codes), 1)
        for m, table in enumerate(tables):
            out += table[:, codes[:, m]]
        return out


def fit(sample: np.ndarray, rows: int) -> Index:
    """An index for so many rows, fitted to a sample of them, in which equal vectors count once."""
    x = np.unique(sample.astype(np.float32), axis=0)
    lists = min(lists_for(rows), max(1, len(x) // LIST_SAMPLE))
    centres = kmeans(x, lists, 1)
    width = -(-x.shape[1] // PARTS)
    index = Index(centres, np.zeros((PARTS, CODES, width), np.float32), lists)
    rest = index.split(x - centres[nearest(x, centres)])
    index.books = np.stack([kmeans(rest[:, m], CODES, 2 + m) for m in range(PARTS)])
    codes = np.column_stack([nearest(rest[:, m], index.books[m]) for m in range(PARTS)])
    lost = rest - np.stack([index.books[m][codes[:, m]] for m in range(PARTS)], 1)
    index.error = float(np.sqrt((lost**2).sum((1, 2)).mean() / x.shape[1]))
    asked = x[:: max(1, len(x) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    step = max(1, HELD // len(x))
    best = np.concatenate([np.argpartition(-(asked[a : a + step] @ x.T), min(NEAREST, len(x) - 1), axis=1)[:, : NEAREST + 1] for a in range(0, len(asked), step)])
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(lists), order.shape).copy(), 1)
    needed = place[np.arange(len(asked))[:, None], nearest(x, centres)[best]]
    index.probes = next(p for p in range(1, lists + 1) if (needed < p).mean() >= RECALL or p == lists)
    return index


def valid(name: str) -> Column:
    """Whether a vector has components, all of them finite, and not all zero."""
    v = F.col(name)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _digest(row: np.ndarray) -> bytes:
    return hashlib.blake2b((row + np.float32(0)).tobytes(), digest_size=16).digest()


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimensions)


def _indexed(index: Index, dimensions: int, keep: int):
    """Distinct vectors of each batch: digest, ids (the smallest, ascending), list, codes, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1), dimensions), batch.column(0).to_pylist()
            held: dict[bytes, list] = {}
            for k, row in enumerate(x):
                held.setdefault(_digest(row), []).append(k)
            first = [k[0] for k in held.values()]
            own, codes = index.encode(x[first])
            smallest = [sorted(ids[i] for i in k)[:keep] for k in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(smallest, pa.list_(pa.int64())), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x[first]], pa.binary())], names=["digest", "ids", "list", "codes", "vector"])

    return run


def _asked(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(row) for row in _matrix(batch.column(1), dimensions)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["query_id", "digest"])

    return run


def _probing(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if digests:
                lists = index.probe(np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1))
                n = lists.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([d for d in digests for _ in range(n)], pa.binary()), pa.array([v for v in vectors for _ in range(n)], pa.binary()), pa.array(lists.ravel().astype(np.int32))], names=["digest", "vector", "list"])

    return run


def _searched(index: Index, keep: int):
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"digest": [], "ids": [], "score": []})
        entries = entries.assign(least=[i[0] for i in entries["ids"]]).sort_values("least", ignore_index=True)
        x = np.frombuffer(b"".join(entries["vector"]), np.float32).reshape(len(entries), -1).astype(np.float64)
        codes = np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(entries), -1)
        q = np.frombuffer(b"".join(queries["vector"]), np.float32).reshape(len(queries), -1)
        near = index.approximate(q, int(entries["list"].iloc[0]), codes)
        n = min(max(RESCORED, keep), len(entries)) - 1
        last = np.partition(-near, n, axis=1)[:, n]
        close = near >= (-last - MARGIN * index.error * np.linalg.norm(q, axis=1))[:, None]
        exact = np.where(close, q.astype(np.float64) @ x.T, -np.inf)
        best = np.argsort(-exact, axis=1, kind="stable")[:, :keep]  # ties: the smallest id, as entries are in that order
        exact = np.take_along_axis(exact, best, 1)
        ids = entries["ids"].to_numpy()
        return pd.DataFrame({"digest": np.repeat(queries["digest"].to_numpy(), best.shape[1]), "ids": [ids[k] for k in best.ravel()], "score": exact.ravel()})

    return run


def search(vectors: DataFrame, queries: Column, most: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where queries holds, the nearest other rows.

    vectors: vec_id, embedding (array of float). Null ids take no part, nor do
    vectors that are null, zero, hold null or non-finite components, or have
    another number of components than most vectors have. rank is from 1, by
    falling score, ties by vec_id; score is the inner product in double precision.
    """
    spark = vectors.sparkSession
    ship(spark)
    keep = most + 1  # one of them may be the query itself
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), queries.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dimensions, n_rows = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("embedding") == dimensions)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, LIST_SAMPLE * lists_for(n_rows))).select("embedding").toArrow().column(0).combine_chunks()
    index = fit(_matrix(sample, dimensions), n_rows)

    entry = "digest binary, ids array<long>, list int, codes binary, vector binary"
    entries = rows.select("vec_id", "embedding").mapInArrow(_indexed(index, dimensions, keep), entry)
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    entries = store(entries.groupBy("digest").agg(smallest.alias("ids"), F.first("list").alias("list"), F.first("codes").alias("codes"), F.first("vector").alias("vector")), "entries")
    asked = store(rows.where("asked").select("vec_id", "embedding").mapInArrow(_asked(dimensions), "query_id long, digest binary"), "asked")
    once = asked.select("digest").distinct().join(entries.select("digest", "vector"), "digest")
    probing = store(once.mapInArrow(_probing(index), "digest binary, vector binary, list int"), "probing")

    # a row for each list
    sides = entries.groupBy("list").count().withColumnRenamed("count", "n").join(probing.groupBy("list").count().withColumnRenamed("count", "q"), "list")
    sides = F.broadcast(sides.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / GROUP).cast("int").alias("groups")))

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        out = df.join(sides, "list").withColumn(own, F.pmod(F.xxhash64("digest"), F.col(own_n)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("blocks", "groups")

    by = ["list", "block", "group"]
    left = dealt(entries, "block", "blocks", "group", "groups").groupBy(*by)
    right = dealt(probing, "group", "groups", "block", "blocks").groupBy(*by)
    found = left.cogroup(right).applyInPandas(_searched(index, keep), "digest binary, ids array<long>, score double")
    # a query has at most probes x keep entries, each with keep ids at most
    pairs = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("ids").alias("ids")))), lambda e: F.transform(e.ids, lambda i: F.struct(e.s.alias("s"), i.alias("vec_id")))))
    answers = found.groupBy("digest").agg(F.slice(F.array_sort(pairs), 1, keep).alias("near"))
    joined = asked.join(answers, "digest")
    others = F.slice(F.filter("near", lambda e: e.vec_id != F.col("query_id")), 1, most)
    return joined.select("query_id", F.posexplode(others).alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def op5_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every 20th vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
