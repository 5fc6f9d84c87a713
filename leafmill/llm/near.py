"""Near-duplicates by a multi-index Hamming join of b-bit minwise signatures, confirmed on full sets.

A document's set is its distinct runs of `words` words. A signature has SYMBOLS
symbols of 16 bits, the low bits of minima under as many hash functions; two sets
of similarity s agree in each symbol with probability s, so those of 0.8 or more
differ in more than REACH symbols less than once in ten million pairs.
Signatures are split into CHUNKS chunks. By the pigeonhole principle two of them
that differ in REACH symbols or fewer have a chunk with one difference at most, so
they agree in one of the keys that leave out one symbol of a chunk: all pairs
within REACH are found.

Keys are exchanged as in removal of passages: blocks of signatures send their
keys, each once, to buckets and get a bit back; only keys that two classes of equal
sets share become rows. Signatures of a key are held against each other, so that
only documents within REACH are connected, and sets that share a key by chance are
not: first all against the key's smallest document; then, in keys whose documents
are not all connected, those beside the largest part against one another and
against that part, of the key or, where these are fewer rows, of all keys.
Documents that are connected are a group. Within a group sets are held against
each other, exactly, in the same two steps. Keys and groups beyond a bound are cut
into parts of bounded size. Rows are links that were found, never pairs that were
tried.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import partitions, ship, store
from leafmill.llm.components import components
from leafmill.llm.substrings import _once, _shared, pack_bits, pack_sorted, unpack_bits
from leafmill.llm.words import mixed, words_of

WORDS, PERCENT = 4, 80
SYMBOLS, CHUNKS = 128, 26
#: Two differences would be needed in every chunk to miss a pair.
REACH = 2 * CHUNKS - 1
#: Text bytes that are hashed at once; signatures of a block; keys that a bucket compares.
BATCH_BYTES, BLOCK_ROWS, BUCKET_KEYS = 4 << 20, 2_000, 4_000_000
#: Set members that a task holds of one group, and sketches of one key, about; twice as many where others are asked about.
GROUP_MEMBERS, KEY_ROWS = 100_000, 4_000
#: Tables of up to so many short rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: How many of a byte's two halves are not zero.
_HALVES = np.array([(b & 15 > 0) + (b >> 4 > 0) for b in range(256)], np.uint8)
_random = np.random.Generator(np.random.PCG64(20_250_303))
_factor = _random.integers(0, 1 << 32, SYMBOLS, np.uint32) | np.uint32(1)
_shift = _random.integers(0, 1 << 32, SYMBOLS, np.uint32)
_weight = _random.integers(0, 1 << 64, SYMBOLS, np.uint64) | np.uint64(1)


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct runs of n words as sorted hashes; A-Z count as a-z. Fewer words: they are one run."""
    words = words_of(texts, lower=True)
    hashes, inside = words.runs(n)
    counts, first = words.counts, words.first
    out = []
    for k, count in enumerate(counts.tolist()):
        a, b = int(first[k]), int(first[k + 1])
        if count >= n:
            out.append(np.unique(hashes[a : b - n + 1]))
        elif count:
            out.append(mixed(np.array([(words.hashes[a:b] * _weight[:count]).sum() + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """sets x SYMBOLS; no set may be empty."""
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat(every * _factor[k] + _shift[k], first)
        out[:, k] = mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """rows x SYMBOLS keys: for each symbol a hash of the others of its chunk."""
    part = signature.astype(np.uint64) * _weight + _weight
    part = mixed(part)
    out = np.empty_like(part)
    bounds = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(int)
    for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
        whole = part[:, a:b].sum(1, dtype=np.uint64)
        out[:, a:b] = whole[:, None] - part[:, a:b] + np.arange(a, b, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def _batched(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for end in range(1, len(texts) + 1):
        size += len(texts[end - 1]) + 1
        if end == len(texts) or size + len(texts[end]) > BATCH_BYTES:
            yield begin, end
            begin, size = end, 0


def _sketched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for begin, end in _batched(texts):
                sets = sets_of(texts[begin:end], n)
                full = [k for k, s in enumerate(sets) if len(s)]
                signs: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full])):
                        signs[k] = row.tobytes()
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return run


_KEYED = pa.schema([("block", pa.int64()), ("nodes", pa.binary()), ("signatures", pa.binary()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
KEYED = "block long, nodes binary, signatures binary, bucket int, n int, keys binary, extra binary"


def _keyed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                raw = b"".join(part.column(1).to_pylist())
                _, keys, bounds, index = _once(keys_of(np.frombuffer(raw, np.uint16).reshape(-1, SYMBOLS)).ravel(), buckets, 32)
                several = np.bincount(index, minlength=len(keys)) > 1
                rows = [(block, part.column(0).to_numpy().astype("<i8").tobytes(), raw, None, None, None, None)]
                rows += [(block, None, None, b, e - s, pack_sorted(keys[s:e], 4), pack_bits(several[s:e])) for b, (s, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if e > s]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEYED)], schema=_KEYED)
                block += 1

    return run


def _members(buckets: int):
    """Rows (key, node) of the keys that others share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes, raw, entries = (batch.column(c)[k].as_py() for c in range(3))
                keys = keys_of(np.frombuffer(raw, np.uint16).reshape(-1, SYMBOLS))
                _, _, bounds, index = _once(keys.ravel(), buckets, 32)
                found = np.zeros(int(bounds[-1]), np.bool_)
                for entry in entries or []:
                    s, e = int(bounds[entry["bucket"]]), int(bounds[entry["bucket"] + 1])
                    found[s:e] = unpack_bits(entry["bits"], e - s)
                hit = np.flatnonzero(found[index])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[hit].view(np.int64)), pa.array(np.frombuffer(nodes, "<i8")[hit // SYMBOLS])], names=["key", "node"])

    return run


class Labels:
    """Components of 0 to n - 1 that grow together.

    known: components that they form already. home: an index whose component is
    home, -1 for none; None: the largest component is home.
    """

    def __init__(self, n: int, known: np.ndarray | None = None, home: int | None = None):
        self.up = np.arange(n)
        self.size = np.ones(n, np.int64)
        if known is not None:
            _, first, index, counts = np.unique(known, return_index=True, return_inverse=True, return_counts=True)
            self.up, self.size = first[index], np.zeros(n, np.int64)
            self.size[first] = counts
        self.fixed = home is not None
        self.home = int(self.size.argmax()) if home is None else int(self.up[home]) if home >= 0 else -1

    def of(self, nodes: np.ndarray) -> np.ndarray:
        found = self.up[nodes]
        while (above := self.up[found]).tobytes() != found.tobytes():
            found = above
        self.up[nodes] = found
        return found

    def join(self, x: int, others: np.ndarray) -> None:
        """Puts the components with these roots into that with the root x."""
        self.up[others] = x
        self.size[x] += self.size[others].sum()
        if (self.home in others) if self.fixed else self.size[x] > self.size[self.home] or self.up[self.home] != self.home:
            self.home = x


def spanned(asked: np.ndarray, labels: Labels, like) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """Links that join the components under a likeness.

    like(x) gives indices that hold all those like x. Every index of asked that is
    not at home is held against all others; those that are left over are in one
    component, so that no pair among them matters.
    """
    waiting = asked.tolist()
    while waiting:
        later = []
        for x in waiting:
            own = int(labels.of(np.array([x]))[0])
            if own == labels.home:
                later.append(x)
                continue
            found = like(x)
            roots, first = np.unique(labels.of(found), return_index=True)
            new = roots != own
            if new.any():
                yield from ((x, int(y)) for y in found[first[new]])
                labels.join(own, roots[new])
        if len(later) == len(waiting):
            return
        waiting = later


def linked(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, asked: np.ndarray | None = None, home: int | None = None) -> list[tuple[int, int]]:
    """Pairs of indices that join the components of sets under 100 * intersection >= percent * union.

    known, home: as Labels takes them; asked: the indices that are to be held
    against all others, unless they are at home (None: all). Two sets that are so alike share one of
    the rarest members of each, as many as may be missing and one more; only sets
    that do are compared.
    """
    n, labels = len(sets), Labels(len(sets), known, home)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, member, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    member = rank[member]
    member = member[np.lexsort((member, owner))]  # each set's members, the rarest first
    rare = sizes - -(-percent * sizes // 100) + 1
    chosen = np.arange(len(member)) - begin[owner] < rare[owner]
    token, holder = member[chosen], owner[chosen]
    order = np.argsort(token, kind="stable")
    holder, first = holder[order], np.searchsorted(token[order], np.arange(len(counts) + 1))
    mark = np.zeros(len(counts), np.bool_)

    def like(x: int) -> np.ndarray:
        own = member[begin[x] : begin[x] + sizes[x]]
        near = np.unique(np.concatenate([holder[first[t] : first[t + 1]] for t in own[: rare[x]].tolist()]))
        near = near[(100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])) & (near != x)]
        near = near[labels.of(near) != labels.of(np.array([x]))[0]]
        if not len(near):
            return near
        length = sizes[near]
        ends = np.cumsum(length)
        at = np.repeat(begin[near] - (ends - length), length) + np.arange(int(ends[-1]))
        mark[own] = True
        both = np.add.reduceat(mark[member[at]].astype(np.int64), ends - length)
        mark[own] = False
        return near[100 * both >= percent * (sizes[x] + length - both)]

    return list(spanned(np.arange(n) if asked is None else asked, labels, like))


def close(sketches: np.ndarray, known: np.ndarray, asked: np.ndarray, home: int | None) -> list[tuple[int, int]]:
    """Pairs of indices that join the components of sketches (rows of bytes, two symbols in each) within REACH."""

    def like(x: int) -> np.ndarray:
        found = np.flatnonzero(_HALVES[sketches ^ sketches[x]].sum(1, dtype=np.int64) <= REACH)
        return found[found != x]

    return list(spanned(asked, Labels(len(sketches), known, home), like))


def _in_parts(links_of):  # noqa: ANN001, ANN202
    """Sorted rows (part, node, label, asked, data): the links within each part.

    label: of the component that a row is known to be in; null: it is at home.
    Where not all rows of a part are asked, the others are at home or ask elsewhere.
    links_of(data, labels, asked, home) gives pairs of indices.
    """

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2 or not any(r[2] for r in rows):
            return []
        codes: dict = {}
        nodes, labels, asked = [r[0] for r in rows], np.array([codes.setdefault(r[1], len(codes)) for r in rows]), np.array([r[2] for r in rows])
        home = None if asked.all() else next((k for k, r in enumerate(rows) if r[1] is None), -1)
        return [(nodes[a], nodes[b]) for a, b in links_of([r[3] for r in rows], labels, np.flatnonzero(asked), home) if nodes[a] != nodes[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in itertools.chain(batches, [None]):
            found: list[tuple[int, int]] = []
            for p, *row in zip(*(batch.column(c).to_pylist() for c in range(5))) if batch else [(None,)]:
                if p != part:
                    found += flush(held)
                    part, held = p, []
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _all_within(percent: int):  # noqa: ANN202
    return lambda data, labels, asked, home: linked([np.frombuffer(x, "<u8") for x in data], percent, labels, asked, home)


def _sketches_within(data: list[bytes], labels: np.ndarray, asked: np.ndarray, home: int | None) -> list[tuple[int, int]]:
    sketches = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    if len(data) == 2:
        return [(0, 1)] if _HALVES[sketches[0] ^ sketches[1]].sum(dtype=np.int64) <= REACH else []
    return close(sketches, labels, asked, home)


def beside(rows: DataFrame, short: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of few columns, which is written down and broadcast if it has few rows."""
    short = store(short, "short")
    return rows.join(F.broadcast(short) if short.count() <= BROADCAST_ROWS else short, by, how)


def dealt(rows: DataFrame, by: str, size: Column, most: int) -> DataFrame:
    """rows (by, node, label, main and others) with part and asked: those whose label is not main ask all of their group.

    The label becomes null where it is main. A group, by `by`, is cut into parts of about `most` by size; those of its rows
    that are asked are cut likewise, and each cut of them goes to all parts.
    """
    rows = rows.withColumn("asked", ~F.col("label").eqNullSafe(F.col("main"))).withColumn("label", F.when(F.col("asked"), F.col("label")))
    total = rows.groupBy(by).agg(F.ceil(F.sum(size) / most).cast("int").alias("_n"), F.ceil(F.sum(F.when(F.col("asked"), size)) / most).cast("int").alias("_m"))
    rows = beside(rows, total.where("_m > 0"), by)
    own, cut = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"), F.pmod(F.hash("node"), F.col("_m")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, asked: F.struct(i.alias("i"), j.alias("j"), asked.alias("a"))
    present = F.transform(F.filter(every("_m"), lambda i: ~F.col("asked") | (i != cut)), lambda i: place(i, own, F.lit(False)))
    asking = F.when(F.col("asked"), F.transform(every("_n"), lambda j: place(cut, j, F.lit(True)))).otherwise(F.array().cast("array<struct<i:int,j:int,a:boolean>>"))
    rows = rows.withColumn("_at", F.explode(F.concat(present, asking))).withColumn("asked", F.col("_at.a"))
    return rows.withColumn("part", F.xxhash64(by, "_at.i", "_at.j")).drop("_n", "_m", "_at", "main")


def _links(parts: DataFrame, data: str, links_of) -> DataFrame:  # noqa: ANN001
    rows = parts.select("part", "node", "label", "asked", data)
    n = partitions(parts.sparkSession)
    return rows.repartition(n, "part").sortWithinPartitions("part", "node").mapInArrow(_in_parts(links_of), "a long, b long")


def _near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sketches those within REACH."""
    for batch in batches:
        if batch.num_rows:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            near = _HALVES[one ^ other].sum(1, dtype=np.int64) <= REACH
            yield batch.select(["a", "b"]).filter(pa.array(near))


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """Four bits of each symbol, two symbols a byte: they differ in no more symbols than the signatures do."""
    low = (signature & np.uint16(15)).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << np.uint8(4)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = sketch_of(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "sketch"])


def grouped(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """node, root: components of documents that share a key and have sketches within REACH.

    members: key, node; sketches: node, sketch.
    """
    leaders = members.groupBy("key").agg(F.min("node").alias("b"))
    stars = members.join(leaders, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    stars = stars.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    stars = store(stars.select("a", "b", "sa", "sb").mapInArrow(_near_stars, "a long, b long"), "stars")
    first = store(components(stars), "first")
    found = members.join(first, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")).repartition("key")
    counts = found.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.max("n").alias("n_main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = store(mixed, "mixed")
    if mixed.isEmpty():
        return first
    aside = store(found.join(mixed.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("label") != F.col("main"))).drop("_key"), "aside")
    # those aside of a key against one another
    among = dealt(aside.where("labels > 2").select("key", "node", "label", F.lit(None).cast("long").alias("main")), "key", F.lit(1), KEY_ROWS)
    # and against its largest part: as the key has it, or as a whole
    asks = aside.select("main", "node", "label").distinct()
    whole = first.select("node", F.col("root").alias("label"))
    sizes = whole.groupBy(F.col("label").alias("main")).agg(F.count("*").alias("n")).join(asks.groupBy("main").agg(F.count("*").alias("q")), "main", "right")
    in_keys = mixed.groupBy("main").agg(F.sum("n_main").alias("in_keys"))
    as_whole = F.coalesce("n", F.lit(1)) + F.col("q") * F.ceil(F.coalesce("n", F.lit(1)) / KEY_ROWS) <= F.col("in_keys")
    chosen = store(sizes.join(in_keys, "main").select("main", as_whole.alias("as_whole")), "chosen")
    cut = beside(mixed, chosen.where("not as_whole").select("main"), "main", "left_semi").select("key", "main")
    by_key = dealt(found.join(cut, "key").select("key", "node", "label", "main"), "key", F.lit(1), KEY_ROWS)
    meant = chosen.where("as_whole").select(F.col("main").alias("group"))
    home = whole.unionByName(asks.select(F.col("main").alias("node"), F.col("main").alias("label"))).distinct().withColumn("group", F.col("label"))
    all_rows = home.unionByName(asks.select("node", "label", F.col("main").alias("group")))
    by_main = dealt(beside(all_rows, meant, "group", "left_semi").withColumn("main", F.col("group")), "group", F.lit(1), KEY_ROWS)
    parts = among.drop("key").unionByName(by_key.drop("key")).unionByName(by_main.drop("group"))
    more = store(_links(parts.join(sketches, "node"), "sketch", _sketches_within), "links")
    return components(stars.unionByName(more)) if not more.isEmpty() else first


def _with_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for begin, end in _batched(texts):
                sets = sets_of(texts[begin:end], n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, end - begin) for c in range(2)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["root", "node", "members"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; others are not read).

    Documents are linked where 100 * intersection >= percent * union of their
    sets; component_id is the smallest doc_id that links reach, kept whether it
    is doc_id. Texts without words, and null texts, have no set and no links.
    Rows of one doc_id count as one document; a row whose doc_id is null takes no
    part and is kept, with a null component_id.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = store(docs.mapInArrow(_sketched(words), "doc_id long, n_shingles long, digest binary, signature binary"), "sketches")
    # a row for each distinct set, however many documents have it
    classes = sketches.where("digest is not null and doc_id is not null").groupBy("digest")
    classes = store(classes.agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size")), "classes")
    buckets = classes.count() * SYMBOLS // BUCKET_KEYS + 1
    staged = store(classes.select("node", "signature").mapInArrow(_keyed(buckets), KEYED), "keys")
    bits = staged.where("bucket is not null").groupBy("bucket").applyInPandas(_shared, "block long, bucket int, bits binary")
    bits = bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("entries"))
    blocks = staged.where("nodes is not null").select("block", "nodes", "signatures")
    shared = blocks.join(bits, "block").select("nodes", "signatures", "entries")
    members = store(shared.mapInArrow(_members(buckets), "key long, node long"), "members")
    short = classes.select("node", "signature").mapInArrow(_sketch, "node long, sketch binary")
    groups = store(grouped(members, short), "groups")

    texts = docs.join(groups.hint("shuffle_hash"), docs.doc_id == groups.node).select("root", "node", "text")
    sets = store(texts.mapInArrow(_with_sets(words), "root long, node long, members binary"), "sets")
    size = F.octet_length("members") / 8
    # a group of up to GROUP_MEMBERS is one part; in the parts of a larger one each set is held against the others and the smallest document's
    total = sets.groupBy("root").agg(F.ceil(F.sum(size) / GROUP_MEMBERS).cast("int").alias("_n"))
    cut = store(total.where("_n > 1"), "cut")
    own = beside(sets, cut, "root", "left").withColumn("asked", F.lit(True)).withColumn("_n", F.coalesce("_n", F.lit(1)))
    own = own.withColumn("_at", F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")))))
    inside = own.select(F.xxhash64("root", "_at").alias("part"), "node", F.monotonically_increasing_id().alias("label"), "asked", "members")
    links = store(_links(inside, "members", _all_within(percent)), "inside")
    roots = components(links)
    if not cut.isEmpty():
        # those of a cut group that are not joined with its smallest document are held against all of it
        roots = store(roots, "roots").select("node", F.col("root").alias("label"))
        rows = store(beside(sets, cut.select("root"), "root", "left_semi").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "rows")
        main = rows.where("node = root").groupBy("root").agg(F.min("label").alias("main"))
        parts = dealt(beside(rows, main, "root").select("root", "node", "label", "main", "members"), "root", size, GROUP_MEMBERS)
        more = store(_links(parts, "members", _all_within(percent)), "across")
        roots = components(links.unionByName(more)) if not more.isEmpty() else roots.select("node", F.col("label").alias("root"))

    by_set = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates, on sets of four-word runs."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
