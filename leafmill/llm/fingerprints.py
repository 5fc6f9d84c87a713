"""Document fingerprints by a randomised edit embedding.

A walk goes over the text's code points. At each step it looks at the code point
it stands on; random bits that all texts share, by step and code point, say
whether it moves on. Two texts with few edits are walked alike but for the edits:
after one the walks drift against each other until they meet, and go on together,
so that edit distance becomes Hamming distance between what the walks saw at the
same steps. How long a walk takes to meet again is random and may be long, so each
text is walked WALKS times, with bits of their own, and two texts are as like as
the likest of their walks says.

Steps are taken STRIDE at a time: the classes of STRIDE code points are one code,
and a table has how far each code moves. A fingerprint keeps what the walks saw, as
4 bits of a hash of the last GRAM code points, at sampled strides. Strides are
sampled ever more thinly for longer texts: level l keeps those whose own random
level is l at least, so that a walk has 128 to 256 samples or so or, for a short
text, one each stride, and fingerprints of two levels are compared at the thinner
one's strides.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import range_ids, ship, store

#: Random bits repeat after PERIOD strides of STRIDE steps; code points count by 4 bits of a hash. Texts lie PAD apart.
WALKS, PERIOD, STRIDE, GRAM, LEAST_CHARS, PAD = 3, 128, 4, 4, 256, 64
#: Code points that are walked at once, and about how much a sorted range of documents holds.
BATCH_CHARS, RANGE_CHARS, MOST_RANGES, TASK_RANGES = 4_000_000, 4_000_000, 1_000_000, 4
#: Up to so many samples have exact keys; about how many classes of one key are held against one another at once.
FEW, PART_CLASSES = 72, 1000
#: A band is as many samples of each WINDOW of samples.
WINDOW = 16
NONE = 255
_TABLES: list[np.ndarray] = []


def moves() -> np.ndarray:
    """WALKS x PERIOD x codes: how many code points a stride moves on from one with that code."""
    if not _TABLES:
        bits = np.random.Generator(np.random.PCG64(20_250_117)).integers(0, 2, (WALKS, PERIOD, STRIDE, 16), np.uint8)
        code = np.arange(16**STRIDE, dtype=np.uint32)
        out = np.empty((WALKS, PERIOD, len(code)), np.uint8)
        for walk in range(WALKS):
            for k in range(PERIOD):
                at = np.zeros(len(code), np.uint8)
                for own in bits[walk, k]:
                    at += own[(code >> (4 * at)) & 15]
                out[walk, k] = at
        _TABLES.append(out)
    return _TABLES[0]


def step_levels(steps: np.ndarray) -> np.ndarray:
    """Each stride's level: half of all strides have 1 at least, a quarter 2, and so on."""
    with np.errstate(over="ignore"):
        h = (steps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        low = h & (~h + np.uint64(1))
    return np.where(h == 0, 63, np.round(np.log2(np.maximum(low, 1).astype(np.float64)))).astype(np.int64)


def _symbols(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: the code of it and those after it, and 4 bits of a hash of it and the GRAM - 1 before it."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        own = (h >> np.uint32(28)).astype(np.uint16)
        code = own.copy()
        for k in range(1, STRIDE):
            code[:-k] |= own[k:] << np.uint16(4 * k)
        gram = h.copy()
        for k in range(1, GRAM):
            gram[k:] += h[:-k] * np.uint32(0x85EBCA6B**k & 0xFFFFFFFF | 1)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x2C1B3C6D)
    return code, (gram >> np.uint32(28)).astype(np.uint8)


def level_of(n: int) -> int:
    return max(0, (max(n, 1) // LEAST_CHARS).bit_length() - 1)


def fingerprints(texts: list[str]) -> list[str]:
    """Each text's fingerprint: its level in hexadecimal, a colon, a digit for each sample, a slash between walks."""
    out: list[str] = []
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
            size, end = size + len(texts[end]), end + 1
        out += _walk(texts[at:end])
        at = end
    return out


def _walk(texts: list[str]) -> list[str]:
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    pad = "\0" * PAD
    points = np.frombuffer((pad.join([texts[k] for k in order] + [""]) + pad).encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.array([len(texts[k]) for k in order], np.int64)
    begin = np.cumsum(n + PAD) - n - PAD
    codes, seen = _symbols(points)
    for k in range(GRAM - 1):  # a text's first grams do not reach into the text before it
        short = begin[n > k] + k
        seen[short] = (points[short] * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    for b, e in zip(begin + n, begin + n + PAD):
        seen[b:e] = NONE
    levels = np.array([level_of(k) for k in n.tolist()], np.int64)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    walks = []
    for table in moves():
        found, counts = _seen(codes, seen, table, begin, n, levels)
        walks.append([digits[own[:count]].tobytes().decode() for own, count in zip(found, counts.tolist())])
    out = [""] * len(texts)
    for k, (text, level) in enumerate(zip(order, levels.tolist())):
        out[text] = f"{level:x}:" + "/".join(own[k] for own in walks)
    return out


def _seen(codes: np.ndarray, seen: np.ndarray, table: np.ndarray, begin: np.ndarray, n: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a walk with this table of moves sees of each text at its sampled strides, and at how many."""
    found = np.full((len(n), 320), NONE, np.uint8)
    counts = np.zeros(len(n), np.int64)
    lane = np.flatnonzero(n)
    here, ends = begin[lane].astype(np.int32), (begin + n)[lane]
    stride, together = 0, PAD // STRIDE
    while len(lane):
        # lanes are in order of length, so the lanes of the lower levels are the last ones
        least = int(levels[lane[-1]])
        if int(counts[lane].max()) + together > found.shape[1]:
            found = np.concatenate([found, np.full_like(found, NONE)], 1)
        firsts = {}
        for s, level in enumerate(step_levels(np.arange(stride, stride + together)).tolist(), stride):
            if level >= least:
                if level not in firsts:
                    firsts[level] = int(np.searchsorted(-levels[lane], -level, "left"))
                own_lanes, what = lane[firsts[level] :], seen[here[firsts[level] :]]
                found[own_lanes, counts[own_lanes]] = what
                counts[own_lanes] += what != NONE
            here += table[s % PERIOD][codes[here]]
        stride += together
        alive = here < ends
        if not alive.all():
            lane, here, ends = lane[alive], here[alive], ends[alive]
    return found, counts


_STEPS: dict[int, np.ndarray] = {}


def _levels_of_samples(level: int, count: int) -> np.ndarray:
    """The levels of the first count strides that level keeps."""
    have = _STEPS.get(level, np.zeros(0, np.int64))
    size = max(1024, 2 * count) << level
    while len(have) < count:
        every = step_levels(np.arange(size))
        have = _STEPS[level] = every[every >= level]
        size *= 2
    return have[:count]


def likeness(a: str, b: str) -> float:
    """From 0 (as like as two texts that have nothing in common) to 1 (the same): that of the likest walk."""
    if a == b:
        return 1.0
    (level, own), (other_level, other) = (x.split(":") for x in (a, b))
    levels = int(level, 16), int(other_level, 16)
    return max(_like(x, y, *levels) for x, y in zip(own.split("/"), other.split("/")))


def _like(a: str, b: str, level: int, other_level: int) -> float:
    one, other = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    if level < other_level:
        one = one[_levels_of_samples(level, len(one)) >= other_level]
    elif other_level < level:
        other = other[_levels_of_samples(other_level, len(other)) >= level]
    most, least = max(len(one), len(other)), min(len(one), len(other))
    if not least:
        return 0.0
    same = np.count_nonzero(one[:least] == other[:least]) / most
    return max(0.0, (same - 1 / 16) / (15 / 16))


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of following's first, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, tail, doc_id, text), sorted; a range's tail is the document after its last one."""
    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        for at in range(0, len(rows), 2000):
            held += rows[at : at + 2000]
            pairs = [(x[2], x[3], y[3]) for x, y in zip(held, held[1:]) if x[0] == y[0] and not x[1]]
            held = held[-1:]
            if pairs:
                yield _judged(pairs)


def _judged(pairs: list[tuple]) -> pa.RecordBatch:
    texts, after = [p[1] for p in pairs], [p[2] for p in pairs]
    changed = [edited(t, f) for t, f in zip(texts, after)]
    once = list(dict.fromkeys([*texts, *after, *changed]))
    print_of = dict(zip(once, fingerprints(once)))
    rows = []
    for (doc_id, t, f), c in zip(pairs, changed):
        a, b = print_of[t], print_of[c]
        rows.append((doc_id, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b), likeness(a, print_of[f])))
    types = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how like these and the next document's are.

    docs: doc_id, text (null: empty); the next document is that of the next
    doc_id (nulls first; rows of one doc_id by text), after the last the first.
    Each row is sent once, to its range of doc_ids, and the first row of a range
    to the range before it as well.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(max(1, size // max(RANGE_CHARS, size // MOST_RANGES)))  # rows of a range are streamed, so it may hold more
    docs = range_ids(docs, "_key", parts, "_range")
    # a row for each range
    heads = [tuple(r) for r in docs.groupBy("_range").agg(F.min("_key").alias("_key")).orderBy("_range").collect()]
    tails = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    to = F.broadcast(spark.createDataFrame(tails, "_key long, _to long"))
    rows = docs.join(to, "_key", "left").withColumn("_wraps", F.col("_to") >= F.col("_range"))
    places = F.filter(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("t")), F.struct(F.col("_to").alias("r"), F.lit(True).alias("t"))), lambda p: p.r.isNotNull())
    rows = rows.select("_key", "doc_id", "text", F.explode(places).alias("p")).select(F.col("p.r").alias("range"), F.col("p.t").alias("tail"), "doc_id", "text", "_key")
    rows = rows.repartition(parts // TASK_RANGES + 8, "range").sortWithinPartitions("range", "tail", "_key", "text")
    return rows.select("range", "tail", "doc_id", "text").mapInArrow(_in_order, RESULT)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            found = fingerprints([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])


def few_keys(own: str, least: float) -> list[str]:
    """Keys that two walks of level 0 and up to FEW samples share if they are as like as least.

    Of most samples, those of the longer one, so many may differ; cut into one run
    more than that, one run is the same in both. most is tried from one's own
    number up to the largest that can be as like.
    """
    share, out = least * 15 / 16 + 1 / 16, []
    for most in range(len(own), min(FEW, int(len(own) / share + 1e-9)) + 1):
        runs = int(most * (1 - share) + 1e-9) + 1
        ends = [most * k // runs for k in range(runs + 1)]
        out += [f"f{most}:{b}:{own[b:e]}" for b, e in zip(ends, ends[1:]) if b < e <= len(own)]
    return out


def _linked(least: float):  # noqa: ANN202
    """Sorted rows (part, class_id, fingerprint): links that join the components within each part."""

    def links(ids: list[int], prints: list[str]) -> Iterator[tuple[int, int, float]]:
        label = list(range(len(ids)))
        for x in range(1, len(ids)):
            for y in range(x):
                if label[x] != label[y] and (like := likeness(prints[x], prints[y])) >= least:
                    yield max(ids[x], ids[y]), min(ids[x], ids[y]), like
                    gone, kept = label[x], label[y]
                    label = [kept if k == gone else k for k in label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, prints = None, [], []
        for batch in itertools.chain(batches, [None]):
            found: list[tuple[int, int, float]] = []
            for part, node, own in zip(*(batch.column(c).to_pylist() for c in range(3))) if batch else [(None, 0, "")]:
                if part != now:
                    found += links(ids, prints)
                    now, ids, prints = part, [], []
                ids.append(node)
                prints.append(own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "like_id", "likeness"])

    return run


def band_keys(fingerprint: str, least: float, band: int) -> list[str]:
    """Keys of a fingerprint: of each walk and each WINDOW of its samples `band` of these, at places that all share.

    They are taken at the document's level and at the next thinner one, and for up
    to FEW samples of level 0 come those of few_keys, so that no pair of them is missed.
    """
    level, walks = int(fingerprint.split(":")[0], 16), fingerprint.split(":")[1].split("/")
    out = []
    for w, own in enumerate(walks):
        if level == 0 and len(own) <= FEW:
            out += [f"{w}{key}" for key in few_keys(own, least)]
        thin = "".join(c for c, k in zip(own, _levels_of_samples(level, len(own))) if k > level)
        for v, samples in ((level, own), (level + 1, thin)):
            for i in range(0, len(samples) - WINDOW + 1, WINDOW):
                out.append(f"{w}:{v}:{i}:" + "".join(samples[i + k] for k in _places(i, band)))
    return out


@lru_cache(4096)
def _places(i: int, band: int) -> tuple[int, ...]:
    """Which samples of the window at i are in its band."""
    return tuple(sorted(np.random.Generator(np.random.PCG64(20_251_100 + i)).permutation(WINDOW)[:band].tolist()))


def near_pairs(docs: DataFrame, least: float = 0.8, band: int = 6) -> DataFrame:
    """doc_id, like_id, likeness: links between documents and ones of smaller ids that share a key with them.

    Documents with one fingerprint are a class, named by its smallest doc_id, and
    give one row to it each. Keys are those of band_keys. Within a key classes are held against one another until all that are as like as `least`
    are in one component; a key of more than PART_CLASSES is cut, and each two of
    its cuts are held against one another. Links span the components; pairs that
    others already join have no row.
    """
    ship(docs.sparkSession)
    every = store(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_prints, "doc_id long, fingerprint string"), "prints")
    classes = store(every.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "classes")

    @F.pandas_udf("array<string>")
    def bands(prints):  # noqa: ANN001, ANN202
        return prints.map(lambda x: band_keys(x, least, band))

    keyed = store(classes.select("class_id", F.explode(bands("fingerprint")).alias("band")), "bands")
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(2 * F.col("n") / PART_CLASSES).cast("int"))
    rows = keyed.join(sizes, "band").withColumn("_own", F.when(F.col("parts") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("class_id"), F.col("parts"))).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.when(F.col("parts") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = rows.select(F.concat_ws("|", F.least("_own", "_other"), F.greatest("_own", "_other"), "band").alias("part"), "class_id").join(classes, "class_id")
    links = rows.select("part", "class_id", "fingerprint").repartition("part").sortWithinPartitions("part", "class_id").mapInArrow(_linked(least), "doc_id long, like_id long, likeness double").distinct()
    own = every.join(classes, "fingerprint").where("doc_id <> class_id").select("doc_id", F.col("class_id").alias("like_id"), F.lit(1.0).alias("likeness"))
    return own.unionByName(links)


def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, held against its edited text's and the next document's."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
