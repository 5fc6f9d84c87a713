"""Evidence on names and forms of address, from profiles of a book's parts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx

# The most identities and JSON signs of a batch.
BATCH_ITEMS, BATCH_CHARS = 20, 20_000


def candidates(found: DataFrame) -> DataFrame:
    """kind, identity, choice, note, first, sources: equal candidates once, with every place that names them, once.

    found: ord, pos, kind, identity, choice, note, chapter, segment; ord numbers the
    profiles, pos the entries of one.
    """
    own = found.withColumn("identity", tx.strip("identity")).withColumn("note", F.coalesce("note", F.lit("")))
    sources = F.sort_array(F.collect_set(F.struct("ord", "chapter", "segment")))
    return own.groupBy("kind", "identity", "choice", "note").agg(F.min(F.struct("ord", "pos")).alias("first"), sources.alias("sources"))


def groups(found: DataFrame) -> DataFrame:
    """kind, identity, first, candidates (in the order they came up first)."""
    own = candidates(found).groupBy("kind", "identity")
    return own.agg(F.min("first").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("first", "choice", "note", "sources"))), lambda x: F.struct(x.choice.alias("choice"), x.note.alias("note"), x.sources.alias("sources"))).alias("candidates"))


def narrative(profiles: DataFrame) -> DataFrame:
    """synopsis, style, source_orders, first: equal summaries once, with the profiles that gave them."""
    return profiles.groupBy("synopsis", F.coalesce("style", F.lit("")).alias("style")).agg(F.sort_array(F.collect_list("ord")).alias("source_orders"), F.min("ord").alias("first"))


def forms(found: DataFrame) -> DataFrame:
    """identity, forms: the different choices for each name, in the order they came up first."""
    own = candidates(found.where("kind = 'glossary'")).groupBy("identity", "choice").agg(F.min("first").alias("first"))
    return own.groupBy("identity").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "choice"))), lambda x: x.choice).alias("forms"))


def batches(evidence: DataFrame, profiles: DataFrame, key: str = "book") -> DataFrame:
    """key, kind, identity, batch: identities in order, in batches of bounded number and JSON length.

    evidence: key, kind, identity, ord, json, orders; profiles: key, ord, json. A
    batch counts the JSON of its identities and, once each, of the profiles that
    they come from; an identity is never parted, so that one alone may be longer.
    """
    own = evidence.select(key, "kind", "identity", "ord", F.length("json").alias("_n"), F.explode_outer(F.array_distinct("orders")).alias("_from"))
    cost = profiles.select(key, F.col("ord").alias("_from"), F.lit(True).alias("_there"), (F.length(F.col("ord").cast("string")) + 4 + F.length("json")).cast("long").alias("_cost"))
    lost = F.raise_error(F.concat(F.lit("no profile "), F.col("_from").cast("string")))
    rows = own.join(cost, [key, "_from"], "left").withColumn("_cost", F.when(F.col("_from").isNotNull() & F.col("_there").isNull(), lost).otherwise(F.col("_cost")))
    rows = rows.withColumn("_kind", F.col("kind") != "glossary").repartition(key).sortWithinPartitions(key, "_kind", "ord", "kind", "identity")
    return rows.select(key, "kind", "identity", "_n", "_from", "_cost").mapInArrow(_filled(key), f"{key} string, kind string, identity string, batch int")


def _filled(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (key, kind, identity, length, profile, its length) to a row for each identity.

    Profiles are held for one batch and one identity, and only as far as both are
    within BATCH_CHARS: beyond that nothing can join them.
    """
    empty = len(json.dumps({"glossary": [], "register": [], "source_context": {}}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, now, out = None, None, []
        batch, count, lists, known, held, n = 0, 0, {}, {}, 0, 0
        own, more, size = {}, 0, 0

        def close() -> None:
            nonlocal batch, count, lists, known, held, n
            kind, length = now[1], n
            new = {**lists, kind: [*lists.get(kind, []), length]}
            context = {**known, **own}
            whole = empty + sum(sum(v) + 2 * (len(v) - 1) for v in new.values()) + held + more + 2 * max(0, len(context) - 1)
            over = held > BATCH_CHARS or size > BATCH_CHARS or whole > BATCH_CHARS
            if count and (count >= BATCH_ITEMS or over):
                batch, count, new, context, held = batch + 1, 0, {kind: [length]}, dict(own), size
            else:
                held += more
            lists, known, count = new, context if held <= BATCH_CHARS else {}, count + 1
            out.append((*now, batch))

        for rows in batches:
            for b, kind, identity, length, profile, cost in zip(*(rows.column(c).to_pylist() for c in range(6))):
                if now != (b, kind, identity):
                    if now is not None:
                        close()
                    if b != book:
                        book, batch, count, lists, known, held = b, 0, 0, {}, {}, 0
                    now, n, own, more, size = (b, kind, identity), length, {}, 0, 0
                if profile is not None:
                    size += cost
                    more += 0 if profile in known else cost
                    if size <= BATCH_CHARS:
                        own[profile] = cost
            if out:
                yield _numbered(out, key)
                out.clear()
        if now is not None:
            close()
            yield _numbered(out, key)

    return run


def _numbered(rows: list[tuple], key: str) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[key, "kind", "identity", "batch"])


def canonical(evidence: DataFrame, choices: DataFrame) -> DataFrame:
    """The canonical choice of each identity, in the order of the evidence (kind, identity, first)."""
    return evidence.select("kind", "identity", "first").join(choices, ["kind", "identity"]).orderBy("kind", "first")


def synopses(profiles: DataFrame) -> DataFrame:
    """chapter, synopsis: the parts' summaries in order, a line each; notes' profiles do not count."""
    own = profiles.where("chapter <> 'footnotes'").groupBy("chapter")
    return own.agg(tx.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "synopsis"))), lambda x: x.synopsis), "\n")).alias("synopsis"))


def stylesheet(glossary: DataFrame, register: DataFrame, style: str) -> DataFrame:
    """One row, text: the style guide as the translator reads it; of a name's entries the first counts.

    glossary: ord, term, czech, note; register: ord, pair, form, note.
    """

    more = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" — "), F.col("note"))).otherwise(F.lit(""))
    first = glossary.where(F.coalesce("term", F.lit("")) != "").groupBy("term").agg(F.min_by(F.struct("czech", "note"), "ord").alias("e"), F.min("ord").alias("ord"))
    names = first.select("ord", F.col("term"), F.col("e.czech").alias("czech"), F.col("e.note").alias("note")).select(F.lit(1).alias("part"), "ord", F.concat(F.lit("- "), "term", F.lit(" → "), F.coalesce("czech", F.lit("")), more).alias("line"))
    pairs = register.select(F.lit(3).alias("part"), "ord", F.concat(F.lit("- "), F.coalesce("pair", F.lit("")), F.lit(": "), F.coalesce("form", F.lit("")), more).alias("line"))
    spark = glossary.sparkSession
    fixed = [(0, k, x) for k, x in enumerate(["# Stylesheet překladu", "", "## Vypravěč a styl", style, "", "## Jména, místa a skloňování"])] + [(2, 0, ""), (2, 1, "## Oslovení (ty/vy)")]
    lines = spark.createDataFrame(fixed, "part int, ord int, line string").unionByName(names.withColumn("ord", F.col("ord").cast("int"))).unionByName(pairs.withColumn("ord", F.col("ord").cast("int")))
    return lines.agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ord", "line"))), lambda x: x.line), "\n"), F.lit("\n")).alias("text"))
