"""Resharding by minimum-cost flow: new shards of nearly equal row counts, moving the fewest bytes.

Old shard sizes and new capacities are a small flow network: a shard with more
rows than it may keep sends some to shards with room, at the price of the rows'
bytes. For any number of rows that leave a shard, its smallest rows are the
cheapest, so the price of the last one is an order statistic of the shard's row
sizes; the network needs no more than that, and has as many nodes as there are
shards.

A layout is a folder of Parquet files, each of rows of one shard in the order of
their sizes, and manifests that name the files of each version. So the rows that
leave a file are its first ones, and a plan is a number for each file. Only files
that lose rows are written anew, without them; what a shard gains are new files.
All others stay as they are, and a version that was not finished leaves none
behind that a manifest names.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import drop_stored, shared_dir, store

SHARDS = 40
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: A task that writes files of shards holds about so many bytes; up to so many files are broadcast as a table.
TASK_BYTES, BROADCAST_FILES = 64 << 20, 200_000
OWN = ("shard", "slot", "moved", "_size")


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximum flow of least cost.

    Successive shortest paths with potentials; costs are not negative.
    """
    graph: list[list[int]] = [[] for _ in range(nodes)]
    ends, room, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, r, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(ends))
            ends.append(y)
            room.append(r)
            cost.append(v)
    height = [0] * nodes
    while True:
        far, via, heap = [float("inf")] * nodes, [-1] * nodes, [(0, source)]
        far[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (new := d + cost[e] + height[x] - height[ends[e]]) < far[ends[e]]:
                    far[ends[e]], via[ends[e]] = new, e
                    heapq.heappush(heap, (new, ends[e]))
        if far[sink] == float("inf"):
            return [room[2 * k + 1] for k in range(len(arcs))]
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = ends[via[x] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


@dataclass
class Transfers:
    """leave: rows that leave each old shard; moves: (from, to, rows), grouped by from."""

    leave: dict[int, int]
    moves: list[tuple[int, int, int]]


def floor_and_rest(rows: int, shards: int) -> tuple[int, int]:
    return rows // shards, rows % shards


def plan(sizes: dict[int, int], last_cost: dict[int, int], shards: int = SHARDS) -> Transfers:
    """Transfers that leave each of the shards 0 to shards - 1 with row counts at most one apart.

    sizes: rows of each old shard; last_cost: for each old shard with more than
    its least capacity, the bytes of the row that it keeps only if it may keep one more.
    Old shards from `shards` on are given up: all their rows leave.
    """
    rows = sum(sizes.values())
    least, more = floor_and_rest(rows, shards)
    old = sorted(set(sizes) | set(range(shards)))
    node = {s: 1 + k for k, s in enumerate(old)}  # each shard's rows; then the shards to be, the pool of moves, the rest
    new = {s: 1 + len(old) + s for s in range(shards)}
    pool, rest, sink = 1 + len(old) + shards, 2 + len(old) + shards, 3 + len(old) + shards
    arcs: list[tuple[int, int, int, int]] = []
    for s in old:
        n = sizes.get(s, 0)
        arcs.append((0, node[s], n, 0))
        if s < shards:
            arcs.append((node[s], new[s], n, 0))
        # rows above least + 1 leave in any plan, at a price that no choice changes
        sure = max(0, n - (least + 1)) if s < shards else n
        arcs.append((node[s], pool, sure, 0))
        if s < shards and n > least:
            arcs.append((node[s], pool, 1, last_cost[s]))
    for s in range(shards):
        arcs += [(pool, new[s], least + 1, 0), (new[s], sink, least, 0), (new[s], rest, 1, 0)]
    arcs.append((rest, sink, more, 0))
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    out, into = {s: 0 for s in old}, {s: 0 for s in range(shards)}
    back, ahead = {v: k for k, v in node.items()}, {v: k for k, v in new.items()}
    for (a, b, _, _), f in zip(arcs, flow):
        if b == pool:
            out[back[a]] += f
        elif a == pool:
            into[ahead[b]] += f
    moves, free = [], [[s, n] for s, n in into.items() if n]
    for s, n in out.items():
        while n:
            take = min(n, free[0][1])
            moves.append((s, free[0][0], take))
            n, free[0][1] = n - take, free[0][1] - take
            if not free[0][1]:
                free.pop(0)
    return Transfers({s: n for s, n in out.items() if n}, moves)


def text_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def text_crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _case(column: str, values: dict[int, int], default: int | None) -> Column:
    out = F.lit(default).cast("long")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v).cast("long")).otherwise(out)
    return out


def lay_out(docs: DataFrame, shard: Column, path: str) -> None:
    """Writes docs into path as the first version of a layout.

    docs: doc_id, text and any others, but those in OWN, which are replaced. shard:
    each row's, 0 or more. Null texts count as empty.
    """
    kept = [c for c in docs.columns if c not in OWN]
    rows = docs.select(*kept, text_size("text").alias("_size"), shard.cast("int").alias("shard"))
    files = _write(rows, path, docs.agg(F.sum(text_size("text"))).first()[0])
    _name_files(docs.sparkSession, path, 0, files, T.StructType([f for f in rows.schema if f.name != "shard"]))


def _write(rows: DataFrame, path: str, total: int | None) -> list[tuple[str, int, int]]:
    """Writes rows (shard, _size and others) into new files of path; file, shard and rows of each.

    Ranges of shard and size are dealt out, so that a task writes few shards; rows
    of one size are told apart by their places, so that many of them are not one range.
    """
    parts = max(8, (total or 0) // TASK_BYTES)
    ranged = rows.repartitionByRange(parts, "shard", "_size", F.monotonically_increasing_id())
    return _put(ranged, path)


def _put(rows: DataFrame, path: str) -> list[tuple[str, int, int]]:
    folder = f"{path}/{uuid.uuid4().hex}"
    rows.sortWithinPartitions("shard", "_size").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    spark = rows.sparkSession
    schema = T.StructType([*[f for f in rows.schema if f.name != "shard"], T.StructField("shard", T.IntegerType())])
    found = spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"), "shard").agg(F.count("*").alias("rows"))
    return [(r.file, r.shard, r.rows) for r in found.collect()]  # a row for each file


_MANIFEST = "file string, shard int, rows long, schema string"


def _name_files(spark: SparkSession, path: str, version: int, files: list[tuple[str, int, int]], schema: T.StructType) -> None:
    rows = [(None, None, None, schema.json()), *[(*f, None) for f in sorted(files)]]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/{version:06d}")


def files_of(spark: SparkSession, path: str, version: int) -> tuple[list[tuple[str, int, int]], T.StructType]:
    """file, shard and rows of each file of a version of a layout, and their columns."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{version:06d}").collect()
    schema = T.StructType.fromJson(json.loads(next(r.schema for r in rows if r.file is None)))
    return sorted((r.file, r.shard, r.rows) for r in rows if r.file is not None), schema


def _rows_of(spark: SparkSession, files: list[tuple], names: str, schema: T.StructType) -> DataFrame:
    """Rows of files, with _file and _at (their place in it), and what else is known of each file; files: file and values."""
    table = store(spark.createDataFrame(files, f"_file string, {names}"), "files")
    table = F.broadcast(table) if len(files) <= BROADCAST_FILES else table
    if not files:
        return spark.createDataFrame([], schema).select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_at")).join(table, "_file")
    read = spark.read.schema(schema).parquet(*[f[0] for f in files])
    return read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")).join(table, "_file")


def read_shards(spark: SparkSession, path: str, version: int) -> DataFrame:
    """All rows of a version of a layout, with shard and slot: the place in the shard, by file and place in it, gapless from 0."""
    files, schema = files_of(spark, path, version)
    start, placed = {}, []
    for file, shard, rows in files:
        placed.append((file, shard, start.get(shard, 0)))
        start[shard] = start.get(shard, 0) + rows
    rows = _rows_of(spark, placed, "shard int, _start long", schema)
    return rows.select(*[c for c in schema.names if c != "_size"], "shard", (F.col("_start") + F.col("_at")).alias("slot"))


def _case(column: str, values: dict[int, int]) -> Column:
    out = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v).cast("long")).otherwise(out)
    return out


def _leaving(spark: SparkSession, files: list[tuple[str, int, int]], schema: T.StructType, shards: int) -> tuple[dict[str, int], Transfers]:
    """How many rows, the first ones, leave each file, and the transfers between shards."""
    sizes: dict[int, int] = {}
    for _, shard, n in files:
        sizes[shard] = sizes.get(shard, 0) + n
    least, _ = floor_and_rest(sum(sizes.values()), shards)
    over = {s: n - least for s, n in sizes.items() if s < shards and n > least}
    rows = _rows_of(spark, [f[:2] for f in files], "shard int", schema).select("_file", "shard", "_size")
    # as many rows as there are sizes, however many rows have them
    counts = rows.groupBy("shard", "_size").agg(F.count("*").alias("n"))
    counts = store(counts.withColumn("upto", F.sum("n").over(Window.partitionBy("shard").orderBy("_size"))), "sizes")

    def smallest(upto: dict[int, int]) -> dict[int, tuple[int, int]]:
        """For each shard the size of its upto-th smallest row and the rows below that size."""
        at = _case("shard", upto)
        hit = counts.where((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at)).collect() if upto else []
        return {r.shard: (r["_size"], r["upto"] - r["n"]) for r in hit}

    found = plan(sizes, {s: v[0] for s, v in smallest(over).items()}, shards)
    limits = smallest(found.leave)
    drop_stored(counts)
    limit = _case("shard", {s: v[0] for s, v in limits.items()})
    each = rows.where(F.col("_size") <= limit).groupBy("_file").agg(F.sum((F.col("_size") < limit).cast("long")).alias("below"), F.sum((F.col("_size") == limit).cast("long")).alias("at"))
    each = {r["_file"]: (r["below"], r["at"]) for r in each.collect()} if limits else {}  # a row for each file
    left = {s: found.leave[s] - below for s, (_, below) in limits.items()}
    out = {}
    for file, shard, _ in files:
        if file in each:
            below, ties = each[file]
            take = min(ties, left[shard])
            left[shard] -= take
            if below + take:
                out[file] = below + take
    return out, found


def reshard(spark: SparkSession, path: str, version: int, shards: int = SHARDS) -> int:
    """Writes the next version of a layout, with rows in the shards 0 to shards - 1, counts at most one apart; its number."""
    files, schema = files_of(spark, path, version)
    leave, found = _leaving(spark, files, schema, shards)
    ends: dict[int, int] = {}
    target = F.lit(None).cast("int")
    for s, t, n in reversed(_ends(found.moves, ends)):
        target = F.when((F.col("shard") == s) & (F.col("_place") < n), F.lit(t).cast("int")).otherwise(target)
    before: dict[int, int] = {}
    touched = []
    for file, shard, _ in files:
        if file in leave:
            touched.append((file, shard, leave[file], before.get(shard, 0)))
            before[shard] = before.get(shard, 0) + leave[file]
    new = [f for f in files if f[0] not in leave]
    if touched:
        rows = _rows_of(spark, touched, "shard int, _leave long, _before long", schema)
        moved = rows.where("_at < _leave").withColumn("_place", F.col("_before") + F.col("_at")).withColumn("shard", target)
        total = moved.agg(F.sum("_size")).first()[0]
        new += _write(moved.select(*schema.names, "shard"), path, total)
        new += _put(rows.where("_at >= _leave").select(*schema.names, "shard"), path)
    _name_files(spark, path, version + 1, new, schema)
    return version + 1


def _ends(moves: list[tuple[int, int, int]], done: dict[int, int]) -> list[tuple[int, int, int]]:
    """Moves with the number of the shard's leaving rows up to their end; a shard's moves follow one another."""
    out = []
    for s, t, n in moves:
        done[s] = done.get(s, 0) + n
        out.append((s, t, done[s]))
    return out


def op2_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out in shards by source, and then in 40 shards of equal row counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.coalesce(F.crc32(F.col("source").cast("binary")), F.lit(0)), F.lit(SHARDS))
    path = f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}-shards"
    lay_out(docs, old, path)
    written = read_shards(spark, path, reshard(spark, path, 0))
    return written.select("doc_id", text_size("text").alias("size"), text_crc("text").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
