"""Token ids in a content-addressed store of files, written and read back.

A rolling hash over the ids cuts each document's id stream into chunks where
its content says so, so that shared passages give shared chunks. The store is a
folder with

- ``chunks``: digest, n, data; each chunk once, ids little-endian in `width` bytes;
- ``recipes``: part, doc_id, start, n_tokens, root, digests, lengths; sorted by doc_id
  within each part, and parts rise with doc_id; root is the Merkle root of the
  chunks' digests;
- ``manifest``: for each part its number of documents and ids and the Merkle root
  over its recipes, in order, and a last row (part null) over the parts.

Reading checks each chunk against its digest, each recipe against its root, and
the recipes that are there against the manifest, so that a chunk, a recipe or a row
of the manifest that is lost or changed is an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import crc
from leafmill.llm.common import drop_stored, partitions, shared_dir, ship, store, stored_at
from leafmill.llm.ordering import running_total
from leafmill.llm.tokens import encoder

DIGEST = 16
#: Chunks among which a task looks for copies.
PART_CHUNKS = 1_000_000
#: A chunk ends where MASK bits of the rolling hash over WINDOW ids are zero: 256 ids on average.
WINDOW, MASK, LEAST, MOST = 16, np.uint32(0xFF << 20), 64, 1024
GEAR = np.random.Generator(np.random.PCG64(20_250_411)).integers(0, 1 << 32, 1 << 16, np.uint32)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\x01" + leaves[i] + leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def rolling(ids: np.ndarray) -> np.ndarray:
    """The sum of g(ids[i - k]) << k over the last WINDOW ids, by doubling; g is a table of random numbers."""
    with np.errstate(over="ignore"):
        h = GEAR[(ids ^ (ids >> np.uint32(16))) & np.uint32(0xFFFF)]
        step = 1
        while step < WINDOW:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h, step = more, step * 2
    return h


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids; they depend on its ids alone."""
    return ends_of(len(ids), np.flatnonzero(rolling(ids) & MASK == 0).tolist())


def ends_of(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of n ids; marks: where the rolling hash says to cut.

    Marks among the first LEAST ids, where the hash may see the document before, don't count.
    """
    ends, begin = [], 0
    if n > LEAST:
        for i in marks:
            while i + 1 - begin > MOST:
                begin += MOST
                ends.append(begin)
            if i + 1 - begin >= LEAST:
                begin = i + 1
                ends.append(begin)
    while n - begin > MOST:
        begin += MOST
        ends.append(begin)
    return ends + [n] if begin < n or not ends else ends


STAGED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.binary()), ("lengths", pa.binary()), ("digest", pa.binary()), ("n", pa.int32()), ("data", pa.binary())])
STAGED_SQL = "doc_id long, n_tokens long, root binary, digests binary, lengths binary, digest binary, n int, data binary"


def _stage(tokenizer: str, end_id: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, kind = encoder(tokenizer), set(), f"<u{width}"
        end = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                docs, chunks = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [x for ids in enc.encode(texts) for x in (ids, end)]
                every = np.concatenate(found)
                marks = np.flatnonzero(rolling(every) & MASK == 0)
                if len(every) and int(every.max()) >> (8 * width):
                    raise ValueError(f"id {int(every.max())} does not fit into {width} bytes")
                every, upto = every.astype(kind), np.cumsum([len(x) for x in found])[1::2].tolist()
                cuts = np.searchsorted(marks, [0, *upto]).tolist()
                for k, (doc_id, begin, stop) in enumerate(zip(part.column(0).to_pylist(), [0, *upto], upto)):
                    ids = every[begin:stop]
                    ends = ends_of(len(ids), (marks[cuts[k] : cuts[k + 1]] - begin).tolist())
                    digests = []
                    for a, b in zip([0, *ends], ends):
                        data = ids[a:b].tobytes()
                        digests.append(d := digest(data))
                        if d not in seen:
                            seen.add(d)
                            chunks.append((d, b - a, data))
                    docs.append((doc_id, len(ids), merkle(digests), b"".join(digests), np.diff([0, *ends]).astype("<u4").tobytes()))
                if len(seen) > 500_000:
                    seen.clear()
                rows = [pa.array(c, f.type) for c, f in zip(zip(*docs), STAGED)] + [pa.nulls(len(docs), f.type) for f in list(STAGED)[5:]]
                yield pa.RecordBatch.from_arrays(rows, schema=STAGED)
                if chunks:
                    rows = [pa.nulls(len(chunks), f.type) for f in list(STAGED)[:5]] + [pa.array(c, f.type) for c, f in zip(zip(*chunks), list(STAGED)[5:])]
                    yield pa.RecordBatch.from_arrays(rows, schema=STAGED)

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()  # a part's digests: about PART_CHUNKS
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, width: int = 2) -> None:
    """Encodes docs' text (null: empty) and writes the store into path.

    docs: doc_id, text; other columns are not read. Rows with the same doc_id
    are documents of their own, in the order of their roots; a null doc_id comes
    first. width: bytes of an id, 2 for vocabularies of up to 65,536; an id that
    needs more is an error.
    """
    spark = docs.sparkSession
    ship(spark)
    staged = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stage(tokenizer, end_id, width), STAGED_SQL), "staged")
    chunks = staged.where("digest is not null").select("digest", "n", "data")
    parts = max(partitions(spark), chunks.count() // PART_CHUNKS + 1)
    stored_at(chunks.repartition(parts, "digest").mapInArrow(_first_of_each, "digest binary, n int, data binary"), f"{path}/chunks")
    found = staged.where("digest is null").select("doc_id", "n_tokens", "root", "digests", "lengths")
    ordered = running_total(found, "doc_id", "n_tokens", "start", ["root"], range_name="part")
    ordered = ordered.select("part", "doc_id", "start", "n_tokens", "root", "digests", "lengths").sortWithinPartitions("part", "start", F.col("doc_id").asc_nulls_first())
    recipes = stored_at(ordered, f"{path}/recipes")
    own = store(_part_roots(recipes), "parts")
    stored_at(own.unionByName(_top_root(own)).coalesce(1), f"{path}/manifest")
    drop_stored(staged)
    drop_stored(own)


@F.pandas_udf(T.BinaryType())
def _merkle_root(leaves):  # noqa: ANN001, ANN202
    """Merkle roots of strings of leaves, DIGEST bytes each."""
    return leaves.map(lambda b: merkle([b[i : i + DIGEST] for i in range(0, len(b), DIGEST)]))


def _leaves(order: str, *values: str) -> Column:
    """The leaves of rows in the order of a column; a row's leaf is a hash of these values."""
    said = F.concat_ws("|", *[F.coalesce(F.hex(v) if v == "root" else F.col(v).cast("string"), F.lit("null")) for v in values])
    leaf = F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * DIGEST)
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), leaf.alias("leaf"))))
    return F.unhex(F.array_join(F.transform(rows, lambda x: x.leaf), ""))


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root; a part is a range of some ten thousand documents."""
    counted = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    roots = recipes.groupBy("part").agg(_leaves("start", "doc_id", "start", "n_tokens", "root").alias("leaves"))
    return counted.join(roots, "part").select("part", "n_docs", "n_tokens", _merkle_root("leaves").alias("root"))


def _top_root(parts: DataFrame) -> DataFrame:
    """One row over all parts; a row and some forty bytes for each part."""
    over = parts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _leaves("part", "part", "n_docs", "n_tokens", "root").alias("leaves"))
    return over.select(F.lit(None).cast("long").alias("part"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), _merkle_root("leaves").alias("root"))


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless the store's recipes are those that its manifest was made from."""
    manifest = spark.read.parquet(f"{path}/manifest")
    own = _part_roots(spark.read.parquet(f"{path}/recipes"))
    both = manifest.where("part is not null").alias("m").join(own.alias("r"), "part", "full")
    same = F.col("m.n_docs").eqNullSafe(F.col("r.n_docs")) & F.col("m.n_tokens").eqNullSafe(F.col("r.n_tokens")) & F.col("m.root").eqNullSafe(F.col("r.root"))
    if bad := both.where(~same).select("part").limit(5).collect():
        raise ValueError(f"recipes do not match the manifest in parts {sorted(r.part for r in bad)}")
    said, found = manifest.where("part is null").collect(), _top_root(manifest.where("part is not null")).first()
    if len(said) != 1 or said[0] != found:
        raise ValueError("the manifest does not match its own Merkle root")


def _checked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest(data) != d:
                    raise ValueError(f"chunk {d.hex()} does not hold what its digest says")
                out.append((d, len(data) // width, zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "n", "crc"])

    return run


def _intact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest(data) != d:
                raise ValueError(f"chunk {d.hex()} does not hold what its digest says")
        yield batch


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe: its root, digest, length and the ids after it."""
    for batch in batches:
        roots, digests, lengths, after = [], [], [], []
        for root, ds, ls in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ds = [ds[i : i + DIGEST] for i in range(0, len(ds), DIGEST)]
            if merkle(ds) != root:
                raise ValueError(f"recipe {root.hex()} does not match its Merkle root")
            n = np.frombuffer(ls, "<u4").astype(np.int64)
            roots += [root] * len(ds)
            digests += ds
            lengths.append(n)
            after.append(n.sum() - np.cumsum(n))
        if roots:
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(digests, pa.binary()), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(after))], names=["root", "digest", "n", "after"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        root, n, after, value, held = (batch.column(i) for i in range(5))
        if (n.to_numpy() != held.to_numpy()).any():
            raise ValueError("a chunk is missing or has another length than its recipe says")
        moved = crc.moved(value.to_numpy(), after.to_numpy())
        yield pa.RecordBatch.from_arrays([root, n, pa.array(moved.astype(np.int64))], names=["root", "n", "crc"])


def read_checked(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store.

    Each chunk's bytes are read and checked once. A document's CRC-32, over ids
    as little-endian unsigned 32-bit integers, is put together from its chunks'
    CRC-32, so bytes need not travel; documents with equal ids share that work.
    """
    ship(spark)
    check_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(_checked(width), "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    once = recipes.groupBy("root").agg(F.first("digests").alias("digests"), F.first("lengths").alias("lengths"))
    parts = once.mapInArrow(_parts, "root binary, digest binary, n long, after long")
    joined = parts.join(chunks.withColumnRenamed("n", "held"), "digest", "left")
    joined = joined.select("root", "n", "after", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("held", F.lit(-1)).alias("held"))
    joined = joined.mapInArrow(_moved, "root binary, n long, crc long")
    whole = joined.groupBy("root").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return recipes.select("doc_id", "start", "root").join(whole, "root").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (array of int) of every document: what the store was written from."""
    ship(spark)
    check_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(_intact, "digest binary, data binary")
    recipes = spark.read.parquet(f"{path}/recipes")
    once = recipes.groupBy("root").agg(F.first("digests").alias("digests"), F.first("lengths").alias("lengths"))
    parts = once.mapInArrow(_parts, "root binary, digest binary, n long, after long").join(chunks, "digest", "left")
    parts = parts.withColumn("data", F.coalesce("data", F.raise_error(F.concat(F.lit("a chunk is missing: "), F.hex("digest"))).cast("binary")))
    hexes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("after"), F.hex("data").alias("h")))), lambda x: x.h), "")
    whole = parts.groupBy("root").agg(F.unhex(hexes).alias("data"))

    @F.pandas_udf("array<int>")
    def ids(data):  # noqa: ANN001, ANN202
        return data.map(lambda b: np.frombuffer(b, f"<u{width}").astype(np.int32))

    return recipes.join(whole, "root").select("doc_id", "start", ids("data").alias("ids"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids with end id 2, written to a store and read back from it."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}-tokens"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_checked(spark, path)
