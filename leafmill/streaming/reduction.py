"""One canonical choice for each name of a book: evidence in batches, a call for each, and checks of what comes back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import hashes
from leafmill.operators import contracts, evidence
from leafmill.streaming import resume

#: A model's answer to a batch: the choice for each identity.
ANSWER = "map<string,map<string,string>>"


def signature(version: str, guide_prompt: str, reduce_prompt: str) -> Column:
    """What canonical choices depend on beside the evidence, as a struct in alphabetical order."""
    return F.struct(F.lit(evidence.BATCH_CHARS).alias("batch_chars"), F.lit(evidence.BATCH_ITEMS).alias("batch_items"), F.lit(guide_prompt).alias("guide_system"), F.lit(reduce_prompt).alias("reduce_system"), F.lit(version).alias("version"))


def covers(data: dict, request: dict) -> None:
    """Raises unless data names each identity of the request, and no other, with a choice that is not blank."""
    asked = json.loads(request["text"])["evidence"]
    for kind in {e["kind"] for e in asked} | set(data):
        want, got = {e["identity"] for e in asked if e["kind"] == kind}, data.get(kind, {})
        if want != set(got):
            raise ValueError(f"{kind}: missing {sorted(want - set(got))[: contracts.SAMPLE]}, extra {sorted(set(got) - want)[: contracts.SAMPLE]}")
        if any(not isinstance(v, str) or not v.strip() for v in got.values()):
            raise ValueError(f"{kind}: a blank choice")


def requests(found: DataFrame, profiles: DataFrame, guide: str, settings: Column) -> DataFrame:
    """stage, key, text, batch: a request for each batch of identities, with the evidence on them.

    found as in evidence.candidates, profiles: ord, json. A batch has at most
    evidence.BATCH_ITEMS identities, so that a row holds a bounded number of them.
    """
    groups = evidence.groups(found)
    orders = F.array_distinct(F.flatten(F.transform("candidates", lambda c: F.transform(c.sources, lambda s: s.ord))))
    own = groups.select(F.lit("").alias("book"), "kind", "identity", F.col("first.ord").alias("ord"), F.to_json(F.struct("identity", "candidates")).alias("json"), orders.alias("orders"))
    numbered = evidence.batches(own, profiles.select(F.lit("").alias("book"), "ord", "json"))
    rows = groups.join(numbered.select("kind", "identity", "batch"), ["kind", "identity"])
    each = F.sort_array(F.collect_list(F.struct("kind", "first", "identity", "candidates")))
    text = F.to_json(F.struct(F.lit(guide).alias("guide"), F.transform("_each", lambda e: F.struct(e.kind.alias("kind"), e.identity.alias("identity"), e.candidates.alias("candidates"))).alias("evidence")))
    batches = rows.groupBy("batch").agg(each.alias("_each")).select("batch", text.alias("text"))
    name = F.format_string("canonical-%04d", "batch")
    return batches.select(F.lit("stylesheet").alias("stage"), hashes.checkpoint_key(name, settings, F.col("text")).alias("key"), "text", "batch")


def reduced(found: DataFrame, profiles: DataFrame, guide: str, settings: Column, path: str, work: Callable[[DataFrame], DataFrame], order: int) -> DataFrame:
    """kind, identity, first, choice: the canonical choice of every identity, in the order of the evidence.

    work: as for resume.run, with clients.Repaired(model, covers) behind it. Batches that have
    a result are not asked for again. Raises if an identity has no choice.
    """
    answers = resume.run(requests(found, profiles, guide, settings), path, work, order)
    kinds = answers.select(F.explode(F.from_json("payload", ANSWER)).alias("kind", "_of"))
    choices = kinds.select("kind", F.explode("_of").alias("identity", "choice"))
    groups = evidence.groups(found)
    contracts.enforce(contracts.coverage(groups.select(F.concat_ws(" ", "kind", "identity").alias("id")), choices.select(F.concat_ws(" ", "kind", "identity").alias("id"))), "canonical choices")
    return evidence.canonical(groups, choices)
