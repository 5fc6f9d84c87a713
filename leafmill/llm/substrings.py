"""Removal of passages that documents with smaller ids hold as well, found by difference-cover anchors.

A window is WINDOW words in a row. Runs of GRAM words are hashed only at places
whose index modulo PERIOD is in COVER. COVER is a difference cover: for any two
places there is a shift below PERIOD that puts both on COVER, so two equal windows
hold the same anchor at the same offset, wherever they begin. Anchors that
documents share are therefore wherever repeats are; only the windows around them
are extended to. These are compared by 96 bits of a cryptographic digest of their
own words, so that neither chance nor a text made for it makes two windows equal.

Documents are read as blocks of some megabytes. A block sends the sorted hashes of
its anchors, each once, to buckets by hash, and gets back a bit for each; the same
goes for windows, with the smallest document id of each. So a passage that a third
of all documents holds is one entry a block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import partitions, shared_dir, ship, store
from leafmill.llm.words import Words, words_of

WINDOW, GRAM, PERIOD, COVER = 13, 7, 7, (0, 1, 3)
#: Text bytes of a block, of what a bucket compares, and of what a task reads at a time.
BLOCK_BYTES, BUCKET_BYTES, TASK_BYTES = 4 << 20, 32 << 20, 24 << 20
#: Tables may not be cut into more parts than this; beyond it a part has more blocks, which are read one by one.
MOST_PARTS = 50_000
ADDED = ("n_words", "n_removed", "kept_text")
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def pack_sorted(values: np.ndarray, size: int) -> bytes:
    """Sorted unsigned integers as the compressed planes of their differences' `size` low bytes."""
    steps = np.diff(values, prepend=values[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return pa.compress(np.ascontiguousarray(steps.T).tobytes(), "zstd", asbytes=True)


def unpack_sorted(data: bytes, n: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :size] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_plain(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_bits(bits: np.ndarray) -> bytes:
    return pa.compress(np.packbits(bits).tobytes(), "zstd", asbytes=True)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(data, (n + 7) // 8, "zstd", asbytes=True), np.uint8), count=n).astype(np.bool_)


def to_payload(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_payload(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(at).to_pylist()]


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and their hashes."""
    hashes, inside = words.runs(GRAM)
    at = np.flatnonzero(inside & np.isin(words.place % PERIOD, COVER))
    return at, hashes[at]


def _once(hashes: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key) of hashes in order: bucket, key, the first bound of each bucket, and each hash's index."""
    bucket = hashes % np.uint64(buckets)
    key = (hashes // np.uint64(buckets)) & np.uint64((1 << bits) - 1)
    order = np.lexsort((key, bucket))
    b, k = bucket[order], key[order]
    new = np.ones(len(b), np.bool_)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    index = np.empty(len(b), np.int64)
    index[order] = np.cumsum(new) - 1
    b, k = b[new], k[new]
    return b, k, np.searchsorted(b, np.arange(buckets + 1)), index


def _digests(texts: list[bytes], words: Words, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of a digest of the window at each of these places, which ascend."""
    digest, out = hashlib.blake2b, []
    cut = np.searchsorted(places, words.first)
    for doc in np.flatnonzero(np.diff(cut)).tolist():
        own = texts[doc].split()
        out += [digest(b" ".join(own[i : i + WINDOW]), digest_size=12).digest() for i in (places[cut[doc] : cut[doc + 1]] - words.first[doc]).tolist()]
    found = np.frombuffer(b"".join(out), np.uint8).reshape(-1, 12)
    return np.ascontiguousarray(found[:, :8]).view("<u8").ravel(), np.ascontiguousarray(found[:, 8:]).view("<u4").ravel()


def _windows(digests: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in the order of bucket, key and rest: key, rest, the first bound of each bucket, and each one's index."""
    key, rest = digests
    bucket = key % np.uint64(buckets)
    order = np.lexsort((rest, key, bucket))
    b, k, r = bucket[order], key[order], rest[order]
    new = np.ones(len(b), np.bool_)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    index = np.empty(len(b), np.int64)
    index[order] = np.cumsum(new) - 1
    return k[new], r[new], np.searchsorted(b[new], np.arange(buckets + 1)), index


STAGED = "block long, payload binary, bucket int, n int, keys binary, extra binary"
_STAGED = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STAGED)], schema=_STAGED)


def _anchor_rows(block: int, words: Words, buckets: int) -> list[tuple]:
    """A row for each bucket: its anchors in this block, each once, and whether two documents of the block hold it."""
    at, hashes = _anchors(words)
    _, keys, bounds, index = _once(hashes, buckets, 32)
    owner = words.owner[at]
    low, high = np.full(len(keys), len(words.first), np.int64), np.full(len(keys), -1, np.int64)
    np.minimum.at(low, index, owner)
    np.maximum.at(high, index, owner)
    several = low != high
    return [(block, None, b, e - s, pack_sorted(keys[s:e], 4), pack_bits(several[s:e])) for b, (s, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if e > s]


def _cut_into_blocks(text_at: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = _texts(batch, text_at)
            begin, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1]) + 1
                if end == len(texts) or size + len(texts[end]) > BLOCK_BYTES:
                    yield _rows([(number, to_payload(batch.slice(begin, end - begin)), None, None, None, None), *_anchor_rows(number, words_of(texts[begin:end]), buckets)])
                    number, begin, size = number + 1, end, 0

    return run


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket, which of its keys another block or two of its documents hold."""
    parts = [unpack_sorted(k, n, 4) for k, n in zip(group["keys"], group["n"])]
    several = np.concatenate([unpack_bits(x, n) for x, n in zip(group["extra"], group["n"])])
    _, index, counts = np.unique(np.concatenate(parts).astype(np.uint32), return_inverse=True, return_counts=True)
    found = (counts > 1)[index] | several
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "bits": [pack_bits(found[e - len(p) : e]) for p, e in zip(parts, ends)]})


def _earlier(group: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket, which of its windows a document with a smaller id than any of the block's holds elsewhere."""
    sizes = group["n"].tolist()
    keys = np.concatenate([unpack_sorted(k, n, 8) for k, n in zip(group["keys"], sizes)])
    rest = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(group["extra"], sizes)])
    least = np.concatenate([unpack_plain(x[4 * n :], n) for x, n in zip(group["extra"], sizes)])
    order = np.lexsort((rest, keys))
    new = np.ones(len(keys), np.bool_)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (rest[order][1:] != rest[order][:-1])
    first = np.minimum.reduceat(least[order], np.flatnonzero(new))
    found = np.empty(len(keys), np.bool_)
    found[order] = first[np.cumsum(new) - 1] < least[order]
    ends = np.cumsum(sizes)
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "bits": [pack_bits(found[e - n : e]) for n, e in zip(sizes, ends)]})


def _answers(entries: list | None, bounds: np.ndarray) -> np.ndarray:
    """A block's bits from its buckets, in the order of its keys."""
    out = np.zeros(int(bounds[-1]), np.bool_)
    for entry in entries if entries is not None else []:
        s, e = int(bounds[entry["bucket"]]), int(bounds[entry["bucket"] + 1])
        out[s:e] = unpack_bits(entry["bits"], e - s)
    return out


LAST_ID = np.iinfo(np.int64).max


def _ids(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _extended(text_at: int, id_at: int, buckets: int):
    """For each block its candidate windows, each once with its smallest document id, and where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, payload, entries = (batch.column(c)[k].as_py() for c in range(3))
                docs = from_payload(payload)
                texts = _texts(docs, text_at)
                words = words_of(texts)
                at, hashes = _anchors(words)
                if not len(at):
                    continue
                _, _, bounds, index = _once(hashes, buckets, 32)
                hit = np.zeros(len(words.hashes) + PERIOD, np.int64)
                hit[at] = _answers(entries, bounds)[index]
                # a window at i holds the anchors at i to i + PERIOD - 1
                upto = np.concatenate([[0], np.cumsum(hit)])
                near = upto[PERIOD : PERIOD + len(words.hashes)] > upto[: len(words.hashes)]
                places = np.flatnonzero(near & words.inside(WINDOW))
                if not len(places):
                    continue
                rows = [(block, None, -1, len(words.hashes), pack_bits(np.isin(np.arange(len(words.hashes)), places, assume_unique=True)), None)]
                keys, rest, bounds, index = _windows(_digests(texts, words, places), buckets)
                least = np.full(len(keys), LAST_ID, np.int64)
                np.minimum.at(least, index, _ids(docs, id_at)[words.owner[places]])
                rows += [(block, None, b, e - s, pack_sorted(keys[s:e], 8), rest[s:e].astype("<u4").tobytes() + pack_plain(least[s:e])) for b, (s, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if e > s]
                yield _rows(rows)

    return run


def _removed(text_at: int, id_at: int, buckets: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                payload, entries = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                docs = from_payload(payload)
                texts = _texts(docs, text_at)
                if where := next((e["bits"] for e in entries or [] if e["bucket"] == -1), None):
                    words = words_of(texts)
                    places = np.flatnonzero(unpack_bits(where, len(words.hashes)))
                    keys, _, bounds, index = _windows(_digests(texts, words, places), buckets)
                    own = _ids(docs, id_at)[words.owner[places]]
                    least = np.full(len(keys), LAST_ID, np.int64)
                    np.minimum.at(least, index, own)
                    again = _answers([e for e in entries if e["bucket"] >= 0], bounds)[index] | (least[index] < own)
                    covered = np.zeros(len(words.hashes) + WINDOW + 1, np.int64)
                    np.add.at(covered, places[again], 1)
                    np.add.at(covered, places[again] + WINDOW, -1)
                    gone = np.cumsum(covered)[: len(words.hashes)] > 0
                    gone_upto = np.concatenate([[0], np.cumsum(gone)])
                    first = words.first.tolist()
                    lost = np.diff(gone_upto[words.first]).tolist()
                else:
                    lost, gone, first = [0] * len(texts), None, None
                counts, texts_kept = [], []
                for i, text in enumerate(texts):
                    own_words = text.split()
                    counts.append(len(own_words))
                    if lost[i]:
                        own_words = [own_words[j] for j in np.flatnonzero(~gone[first[i] : first[i + 1]]).tolist()]
                    texts_kept.append(b" ".join(own_words))
                columns = [docs.column(docs.schema.get_field_index(c)) for c in kept]
                columns += [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts_kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *ADDED])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words, one space between them).

    docs: doc_id, text and any others; columns with the added names are replaced.
    A word is removed where a window that covers it also begins in a document with
    a smaller doc_id; windows are those of the texts as they came in. Rows of one
    doc_id are one document in this respect; a null doc_id is larger than all
    others; a null text has no words.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*kept)
    text_at, id_at = kept.index("text"), kept.index("doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # with fewer parts than a shuffle has, a join would rather shuffle the blocks
    buckets, parts = int(size // BUCKET_BYTES) + 1, int(min(MOST_PARTS, max(size // TASK_BYTES + 8, partitions(spark))))

    # blocks are dealt into a table's buckets by their number, so that they are read three times, but never shuffled
    name = f"leafmill_blocks_{uuid.uuid4().hex}"
    staged = docs.mapInArrow(_cut_into_blocks(text_at, buckets), STAGED)
    staged.write.bucketBy(parts, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/leafmill/{name}").saveAsTable(name)
    blocks = spark.table(name).where("payload is not null").select("block", "payload")

    def answered(rows: DataFrame, answer) -> DataFrame:  # noqa: ANN001
        return rows.groupBy("bucket").applyInPandas(answer, "block long, bucket int, bits binary")

    def by_block(bits: DataFrame) -> DataFrame:
        return bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("entries"))

    anchors = spark.table(name).where("bucket is not null").select("block", "bucket", "n", "keys", "extra")
    shared = store(answered(anchors, _shared), "shared")
    found = blocks.join(by_block(shared).hint("shuffle_hash"), "block", "left").select("block", "payload", "entries")
    windows = store(found.mapInArrow(_extended(text_at, id_at, buckets), STAGED).select("block", "bucket", "n", "keys", "extra"), "windows")
    earlier = answered(windows.where("bucket >= 0"), _earlier)
    earlier = earlier.unionByName(windows.where("bucket < 0").select("block", "bucket", F.col("keys").alias("bits")))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    last = blocks.join(by_block(store(earlier, "earlier")).hint("shuffle_hash"), "block", "left").select("payload", "entries")
    return last.mapInArrow(_removed(text_at, id_at, buckets, kept), schema)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds, as a digest."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
