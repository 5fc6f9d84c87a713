"""Texts laid over texts: patches over a draft, settings over settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx


def usable_patches(patches: DataFrame, known: DataFrame) -> DataFrame:
    """Patches (id, text) of known ids that are not blank; the others are dropped."""
    return patches.where(tx.strip("text") != "").join(known.select("id"), "id", "left_semi")


def overlay(ids: DataFrame, draft: DataFrame, patches: DataFrame) -> DataFrame:
    """ord, id, text in book order: the patch of each id of ids (ord, id), else its draft, else null."""
    over = usable_patches(patches, ids).select("id", F.col("text").alias("_patch"))
    return ids.join(draft.select("id", "text"), "id", "left").join(over, "id", "left").select("ord", "id", F.coalesce("_patch", "text").alias("text"))


def missing(final: DataFrame) -> DataFrame:
    """Ids of final texts that are missing or blank."""
    return final.where(F.col("text").isNull() | (tx.strip("text") == "")).select("id")


def changed(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (id, text) whose text is not the current one."""
    return new.join(current.select("id", F.col("text").alias("_now")), "id").where(F.col("text") != F.col("_now")).select("id", "text")


def latest(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Of the rows of each key the one that came last: later wins."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return best.select(*keys, "_r.*")


def layered(*layers: DataFrame) -> DataFrame:
    """name, value of settings (name, value), lowest layer first; a name that is present wins, even with an empty value."""
    tagged = [layer.select("name", "value", F.lit(k).alias("ord")) for k, layer in enumerate(layers)]
    return latest(reduce(DataFrame.unionByName, tagged), "name").select("name", "value")
