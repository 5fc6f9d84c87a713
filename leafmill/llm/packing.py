"""Best-fit packing of documents' token ids into sequences of a fixed length.

What is packed is decided on the histogram of lengths, which has at most
`capacity` entries however many documents there are. First Martello and Toth's
dominance criterion fixes sets of up to two items that are in some best
solution; what is left goes best fit, longest first. Both steps place runs of
equal pieces at once: a run is given by the ranks of its pieces among all pieces
of that length, and by the sequences it goes into. So placing a piece is a
look-up of its length and rank, without a shuffle of token ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import ship, store
from leafmill.llm.tokens import WordEncoder, encoder

CAPACITY = 4096


@dataclass
class Plan:
    """Runs: length, first rank, pieces, first sequence, pieces a sequence, offset of the first."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0  # pieces that the dominance criterion placed


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packs histogram (length: number of pieces; lengths from 1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit into {capacity}")
        left[length] = n
    plan, ranks = Plan(capacity), np.zeros(capacity + 1, np.int64)

    def put(length: int, n: int, base: int, each: int, offset: int) -> None:
        plan.runs.append((length, int(ranks[length]), int(n), int(base), int(each), int(offset)))
        ranks[length] += n
        left[length] -= n

    while _reduce(left, capacity, plan, put):
        pass
    plan.fixed = int(ranks.sum())
    _best_fit(left, capacity, plan, put)
    return plan


def _smallest(left: np.ndarray, but: int, n: int) -> list[int]:
    """The n smallest lengths that are left besides one piece of length but."""
    out = []
    for length in np.flatnonzero(left).tolist():
        out += [length] * min(n - len(out), int(left[length]) - (length == but))
        if len(out) == n:
            break
    return out


def _reduce(left: np.ndarray, capacity: int, plan: Plan, put) -> bool:  # noqa: ANN001
    """One pass over the lengths, longest first; True if a set was fixed.

    A set {i} or {i, k} is fixed where it dominates every feasible set with i: no
    other piece fits beside i; or k fills the rest exactly; or the longest k that
    fits is at least as long as any two or more pieces that fit together.
    """
    found = False
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length] > 0:
            rest = capacity - length
            small = _smallest(left, length, 3)
            if not small or small[0] > rest:
                n = int(left[length])
                put(length, n, plan.sequences, 1, 0)
                plan.sequences += n
                found = True
                continue
            left[length] -= 1  # the piece i itself is no partner
            there = np.flatnonzero(left[: rest + 1])
            left[length] += 1
            k = int(there[-1])
            if k != rest and len(small) > 1 and small[0] + small[1] <= rest:
                if len(small) > 2 and sum(small) <= rest:
                    break  # three more pieces may fit: not decided here
                under = np.maximum.accumulate(np.where(np.isin(np.arange(rest + 1), there), np.arange(rest + 1), 0))
                pairs = there + under[rest - there]
                alone = (under[rest - there] == there) & (left[there] - (there == length) < 2)
                pairs[alone] = there[alone] + np.where(there[alone] > 0, under[np.maximum(there[alone] - 1, 0)], 0)
                if pairs[pairs <= rest].max(initial=0) > k:
                    break
            n = int(left[length]) // 2 if k == length else int(min(left[length], left[k]))
            if n == 0:
                break
            put(length, n, plan.sequences, 1, 0)
            put(k, n, plan.sequences, 1, length)
            plan.sequences += n
            found = True
    return found


def _best_fit(left: np.ndarray, capacity: int, plan: Plan, put) -> None:  # noqa: ANN001
    """Longest first, each piece into the sequence with the least room that still takes it."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        at = length
        while n := int(left[length]):
            while at <= capacity and not room[at]:
                at += 1
            if at <= capacity:
                space, (base, count) = at, room[at].pop()
            else:
                space, base, count = capacity, plan.sequences, -(-n // (capacity // length))
                plan.sequences += count
            each = min(space // length, n)
            full = min(count, n // each)
            put(length, full * each, base, each, capacity - space)
            if count > full:
                room[space].append((base + full, count - full))
                at = min(at, space)
            if rest := space - each * length:
                room[rest].append((base, full))
                at = min(at, rest) if rest >= length else at


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, counts, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer, WordEncoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, begin in enumerate(range(0, len(ids), capacity)):
                        own = ids[begin : begin + capacity]
                        rows.append((doc_id, k, begin, len(own), own.tobytes(), task, int(counts[len(own)])))
                        counts[len(own)] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids", "task", "rank"])

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A stored row for each piece of each document: doc_id, piece, start, length, ids (binary), task, rank.

    docs: doc_id, text (null: empty, so that the end id alone is left); other
    columns are not read, and rows with the same doc_id are documents of their own.
    """
    ship(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids binary, task int, rank long")
    return store(out, "pieces")


def _place(plan: Plan):
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            own = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            at = rank - own[:, 1]
            yield batch.append_column("sequence_id", pa.array(own[:, 3] + at // own[:, 4])).append_column("offset", pa.array(own[:, 5] + at % own[:, 4] * length))

    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found, the table of pieces(), with sequence_id and offset.

    A piece's rank among all of its length is its rank in its task and the number
    of such pieces in the tasks before; no task sees all pieces of one length.
    """
    counts = store(found.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    plan = solve({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # capacity rows at most
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("_before"))
    ranked = found.join(before, ["task", "length"]).withColumn("_rank", F.col("rank") + F.col("_before")).drop("_before", "rank", "task")
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_place(plan), schema).drop("_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, length, ids (binary) of each sequence of pack()'s pieces."""
    own = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(own, lambda x: x.h), "")).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 ids."""
    import public_tokenizers

    found = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    lean = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "rank")
    return pack(lean).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
