"""Fingerprints of content and of what it was made from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leads every fingerprint, so that a change of the pipeline makes all results anew.
VERSION = "leafmill-1"


def job_id(content: Column) -> Column:
    """The id of an imported file: sha1 of its bytes."""
    return F.sha1(content)


def fingerprint(*values: Column) -> Column:
    """sha256 of a compact JSON array of the version and the values.

    Strings are quoted and escaped, structs and maps written as objects; a struct's
    fields should be in alphabetical order, as a canonical form has them.
    """
    quoted = [F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for v in values]
    parts = [F.lit(f'"{VERSION}"'), *[F.when(v.isNull(), F.lit("null")).otherwise(q) for v, q in zip(values, quoted)]]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def checkpoint_key(name: Column, *values: Column) -> Column:
    return F.concat(name, F.lit("-"), F.substring(fingerprint(*values), 1, 24))


def speech_key(text: Column, before: Column, after: Column) -> Column:
    """The key of a spoken chunk: its text and what is around it, as spaced JSON in alphabetical order."""

    def quoted(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    whole = F.concat(F.lit('{"future_text": '), quoted(after), F.lit(', "previous_text": '), quoted(before), F.lit(', "text": '), quoted(text), F.lit("}"))
    return F.sha2(whole, 256)


def model_settings(model: Column, draft_model: str, effort: str, draft_effort: str) -> Column:
    """The settings that a model's answers depend on, as a struct in alphabetical order."""
    own = F.when(model == draft_model, F.lit(draft_effort)).otherwise(F.lit(effort))
    return F.struct(model.alias("model"), own.alias("reasoning_effort"))
