"""Contracts on tables of texts. A check returns the rows that break it; enforce() raises for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

FORMS = ("ty", "vy", "contextual")  # fixed values: forms of address in a register
GUIDE_WORDS = 900
SAMPLE = 8


class ContractError(ValueError):
    """Rows that break a contract; the message names some of them."""


def enforce(violations: DataFrame, what: str) -> None:
    """Raises if there is a violation, with the first few in order."""
    columns = violations.columns
    some = [tuple(r) for r in violations.orderBy(*columns).limit(SAMPLE).collect()]
    if some:
        raise ContractError(f"{what}: {some}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(source: DataFrame, output: DataFrame, key: str = "id", partial: bool = False) -> DataFrame:
    """Ids that source has and output lacks (problem `missing`, not if partial), or the other way round (`extra`)."""
    missing = source.join(output, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = output.join(source, key, "left_anti").select(key, F.lit("extra").alias("problem"))
    return extra if partial else missing.unionByName(extra)


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether both tables have the same set of ids."""
    return coverage(a, b, key).isEmpty()


def sample_ids(violations: DataFrame, key: str = "id", n: int = SAMPLE) -> DataFrame:
    """A row for each problem: its number of ids, and the first n of them in order."""
    first = violations.select("problem", key).distinct()
    rank = F.row_number().over(Window.partitionBy("problem").orderBy(key))
    first = first.withColumn("_n", rank).groupBy("problem")
    return first.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("_n") <= n, F.col(key)))), ",").alias("sample"))


def text_map_violations(source: DataFrame, output: DataFrame, partial: bool = False) -> DataFrame:
    """id, problem for each way in which output (id, text) is no full answer to source (id, text).

    Ids must be the same (a part of them, if partial), texts not blank, anchors
    the same in the same order, and texts without letters copied exactly.
    """
    both = source.select("id", F.col("text").alias("_source")).join(output.select("id", "text"), "id")
    found = F.array(
        F.when(F.col("text").isNull() | (tx.strip("text") == ""), F.lit("blank")),
        F.when(tx.note_ids("_source", wide=True) != tx.note_ids("text", wide=True), F.lit("anchors")),
        F.when(tx.is_immutable("_source") & (F.col("text") != F.col("_source")), F.lit("immutable")),
    )
    inside = both.select("id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))
    return coverage(source, output, "id", partial).unionByName(inside)


def restored(source: DataFrame, output: DataFrame) -> DataFrame:
    """output with the texts of its immutable entries taken from source; nothing else changes."""
    own = source.where(tx.is_immutable("text")).select("id", F.col("text").alias("_exact"))
    return output.join(own, "id", "left").withColumn("text", F.coalesce("_exact", "text")).drop("_exact")


def editable(source: DataFrame) -> DataFrame:
    """The entries that a model has to answer."""
    return source.where(~tx.is_immutable("text"))


def dangling(texts: DataFrame, notes: DataFrame, wide: bool = True) -> DataFrame:
    """id, note_id of anchors in texts (id, text) without a note in notes (note_id)."""
    used = texts.select("id", F.explode(tx.note_ids("text", wide)).alias("note_id")).distinct()
    return used.join(notes.select("note_id"), "note_id", "left_anti").select("id", "note_id")


def anchors_kept(source: DataFrame, output: DataFrame) -> DataFrame:
    """Ids whose anchors, as a multiset, are not those of the source."""
    both = source.select("id", F.col("text").alias("_source")).join(output.select("id", "text"), "id", "left")
    changed = F.sort_array(tx.note_ids("_source")) != F.sort_array(tx.note_ids(F.coalesce("text", F.lit(""))))
    return both.where(changed).select("id")


def source_violations(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """What is wrong with source entries (id, text): repeated ids, blank texts, unresolved anchors."""
    repeated = duplicates(entries, "id").select("id", F.lit("duplicate").alias("problem"))
    blank = entries.where(F.col("text").isNull() | (tx.strip("text") == "")).select("id", F.lit("blank").alias("problem"))
    lost = dangling(entries, notes).select("id", F.lit("unresolved").alias("problem")).distinct()
    return repeated.unionByName(blank).unionByName(lost)


def profile_violations(register: DataFrame, glossary: DataFrame, canonical: bool = False) -> DataFrame:
    """kind, identity, problem for entries of register (pair, form, note) and glossary (term, czech, note)."""

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (tx.strip(c) == "")

    unknown = register.where(~F.col("form").isin(*FORMS) | F.col("form").isNull()).select(F.lit("register").alias("kind"), F.col("pair").alias("identity"), F.lit("form").alias("problem"))
    unexplained = register.where((F.col("form") == "contextual") & blank("note")).select(F.lit("register").alias("kind"), F.col("pair").alias("identity"), F.lit("note").alias("problem"))
    empty = glossary.where(blank("term") | F.col("czech").isNull()).select(F.lit("glossary").alias("kind"), F.col("term").alias("identity"), F.lit("text").alias("problem"))
    nameless = register.where(blank("pair")).select(F.lit("register").alias("kind"), F.col("pair").alias("identity"), F.lit("text").alias("problem"))
    out = unknown.unionByName(unexplained).unionByName(empty).unionByName(nameless)
    if canonical:
        for kind, df, name in (("register", register, "pair"), ("glossary", glossary, "term")):
            again = duplicates(df.select(tx.strip(name).alias(name)), name)
            out = out.unionByName(again.select(F.lit(kind).alias("kind"), F.col(name).alias("identity"), F.lit("duplicate").alias("problem")))
    return out


def guide_violations(guides: DataFrame) -> DataFrame:
    """id, problem for guides (id, style, character_context): texts must be there and have 900 words at most."""
    size = tx.word_count(F.concat_ws(" ", "style", "character_context"))
    found = F.when(F.col("style").isNull() | (tx.strip("style") == "") | F.col("character_context").isNull(), F.lit("text")).when(size > GUIDE_WORDS, F.lit("long"))
    return guides.select("id", found.alias("problem")).where("problem is not null")


def page_violations(pages: DataFrame, notes: DataFrame, continuations: DataFrame, version: int) -> DataFrame:
    """page_no, problem for extracted pages.

    pages: schema_version, page_no, expected_no, asset_paths (array), text,
    external_notes (array); notes: page_no, note_id, text; continuations: page_no, note_id.
    """
    found = F.array(
        F.when(~F.col("schema_version").eqNullSafe(version), F.lit("version")),
        F.when(~F.col("page_no").eqNullSafe(F.col("expected_no")), F.lit("index")),
        F.when(F.exists("asset_paths", lambda p: ~p.startswith("assets/") | p.contains("..")), F.lit("asset")),
    )
    own = pages.select("page_no", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))
    repeated = duplicates(notes, "page_no", "note_id").select("page_no", F.lit("duplicate note").alias("problem"))
    blank = notes.where(F.coalesce(tx.strip("text"), F.lit("")) == "").select("page_no", F.lit("blank note").alias("problem"))
    known = notes.select("page_no", "note_id").unionByName(pages.select("page_no", F.explode("external_notes").alias("note_id")))
    used = pages.select("page_no", F.explode(tx.note_ids("text")).alias("note_id"))
    lost = used.join(known, ["page_no", "note_id"], "left_anti").select("page_no", F.lit("anchor").alias("problem"))
    foreign = pages.select("page_no", F.explode("external_notes").alias("note_id")).unionByName(continuations.select("page_no", "note_id"))
    foreign = foreign.join(notes.select("note_id").distinct(), "note_id", "left_anti").select("page_no", F.lit("unknown note").alias("problem"))
    return own.unionByName(repeated).unionByName(blank).unionByName(lost).unionByName(foreign).distinct()


def pcm_violations(sounds: DataFrame) -> DataFrame:
    """id, problem for sounds (id, n_bytes, sample_rate, channels, sample_width)."""
    found = F.when(F.col("sample_rate") <= 0, F.lit("rate")).when(~F.col("sample_width").between(1, 4), F.lit("width")).when((F.col("channels") < 1) | (F.col("n_bytes") % (F.col("channels") * F.col("sample_width")) != 0), F.lit("frames"))
    return sounds.select("id", found.alias("problem")).where("problem is not null")


def config_violations(config: dict) -> list[str]:
    """Names of settings that are out of range; settings live on the driver."""
    ranges = {"workers": (1, 32), "audio_workers": (1, 16), "font_size": (12, 24), "max_chunk_words": (1, 1 << 31)}
    efforts = ("none", "low", "medium", "high")
    bad = [k for k, (low, high) in ranges.items() if k in config and not (isinstance(config[k], int) and not isinstance(config[k], bool) and low <= config[k] <= high)]
    return bad + [k for k in ("reasoning_effort", "draft_reasoning_effort") if k in config and config[k] not in efforts]
