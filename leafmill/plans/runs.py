"""Queries on runs: stages to do, calls, canonical choices, scripts that are read, and results in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.ext import services
from leafmill.functions import hashes
from leafmill.operators import memo, notes, speech
from leafmill.plans.tables import _EVIDENCE, _JOBS, _evidence, _jobs
from leafmill.plans.texts import _ANCHORED, _anchored, _notes, documents, longs, md5, table
from leafmill.streaming import reduction, stages


def pending_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, lines as what their stages left."""
    jobs, _ = _jobs(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("pages", "book", "synopses", "stylesheet", "patches", "draft", "final")])
    artifacts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.element_at(names, ((F.col("l_partkey") + F.col("l_linenumber")) % 7 + 1).cast("int")).alias("name"))
    return longs(stages.pending(jobs, artifacts))


PENDING_STAGES = f"""
WITH {_JOBS},
have AS (SELECT DISTINCT l_orderkey AS job_id, ['pages', 'book', 'synopses', 'stylesheet', 'patches', 'draft', 'final'][(l_partkey + l_linenumber) % 7 + 1] AS name FROM lineitem),
plan AS (SELECT * FROM (VALUES (0, 'ingest', 'pages'), (1, 'segment', 'book'), (2, 'stylesheet', 'synopses'), (2, 'stylesheet', 'stylesheet'), (3, 'translate', 'patches'), (3, 'translate', 'draft'), (4, 'merge', 'final'), (5, 'typeset', NULL)) p(ord, stage, name))
SELECT DISTINCT j.job_id, CAST(p.ord AS BIGINT) AS ord, p.stage FROM jobs j CROSS JOIN plan p
WHERE p.name IS NULL OR NOT EXISTS (SELECT 1 FROM have h WHERE h.job_id = j.job_id AND h.name = p.name)"""


def paired_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs; some have an output, some an imported PDF, some only a note of their kind."""
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer")
    jobs = own.select(key.alias("job_id"), F.when(key % 5 == 0, F.col("c_name")).when(key % 5 == 1, F.lit("")).alias("output"), F.when(key % 3 == 0, F.lit("czech_pdf")).otherwise(F.lit("txt")).alias("kind"))
    copies = own.where("c_custkey % 2 = 0").select(key.alias("job_id"), F.lit("source_pdf").alias("name"), F.concat(F.lit("jobs/"), F.col("c_name")).alias("path"), F.lit(None).cast("string").alias("kind"))
    noted = own.where("c_custkey % 7 = 0").select(key.alias("job_id"), F.lit("audio_source").alias("name"), F.lit(None).cast("string").alias("path"), F.when(key % 2 == 0, F.lit("czech_pdf")).alias("kind"))
    return memo.paired_source(jobs, copies.unionByName(noted))


PAIRED_SOURCES = """
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 = 0 AND c_name <> '' THEN c_name
  WHEN c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_custkey % 7 = 0) THEN 'jobs/' || c_name END AS path
FROM customer"""


def called_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document given to a stand-in of a model; what fails is noted, and the others go on."""
    failed = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("[[fail]] "), "text")).otherwise(F.col("text"))
    items = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), failed.alias("text"))
    done = services.called(items, services.StandIn)
    return done.select("key", "status", F.when(F.col("status") == "success", md5("payload")).alias("draft"))


# the stand-in writes ß as SS in capitals, upper() of SQL does not
CALLED_TEXTS = """
SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 9 = 4 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 9 <> 4 THEN md5(upper(replace(text, 'ß', 'SS'))) END AS draft
FROM documents"""


def reduction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for canonical choices: all identities of the documents, each in one batch."""
    profiles = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("text").alias("json"))
    own = reduction.requests(_evidence(spark, sf_dir), profiles, "calm", reduction.signature("1", "g", "r"))
    asked = F.from_json("text", "guide string, evidence array<struct<kind string, identity string, candidates array<struct<choice string, note string>>>>")
    each = own.select("batch", F.posexplode(asked.evidence).alias("at", "e"))
    return longs(each.select("e.kind", "e.identity", F.array_join(F.transform("e.candidates", lambda c: c.choice), ",").alias("choices")))


REDUCTION_REQUESTS = f"""
WITH {_EVIDENCE}, c AS (SELECT identity, choice, min(ord) AS first FROM found GROUP BY ALL)
SELECT 'glossary' AS kind, identity, string_agg(choice, ',' ORDER BY first) AS choices FROM c GROUP BY identity"""


def reduction_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as prompts: the JSON of what their choices depend on, and its digest as a checkpoint's key has it."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.lit(20_000).alias("batch_chars"), F.lit(20).alias("batch_items"), F.col("p_name").alias("guide_system"), F.col("p_type").alias("reduce_system"), F.lit("1").alias("version")).alias("s"))
    return rows.select("p_partkey", F.to_json("s").alias("signature"), hashes.checkpoint_key(F.lit("canonical-guide"), F.col("s")).alias("key"))


REDUCTION_SIGNATURES = f"""
WITH own AS (SELECT p_partkey, '{{"batch_chars":20000,"batch_items":20,"guide_system":"' || p_name || '","reduce_system":"' || p_type || '","version":"1"}}' AS signature FROM part)
SELECT *, 'canonical-guide-' || left(sha256('["{hashes.VERSION}",' || signature || ']'), 24) AS key FROM own"""


def chapter_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read in each chapter of ten documents: anchored texts, the notes that each reads first, then free notes."""
    texts = _anchored(spark, sf_dir).withColumn("chapter_no", F.floor(F.col("ord") / 10))
    bodies = _notes(spark).withColumn("text", F.concat(F.lit("body of "), "note_id"))
    free = spark.range(40, 45).select(F.format_string("fn-p%04d-001", F.col("id").cast("int")).alias("note_id"), (F.col("id") * 2).alias("note_ord"))
    bodies = bodies.unionByName(free.withColumn("text", F.lit("free[^1] note")))
    last = texts.agg(F.max("chapter_no").alias("chapter_no")).withColumn("_one", F.lit(1))
    unanchored = free.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").select("note_id", "chapter_no")
    found = speech.chapter_scripts(texts, bodies, notes.readers(texts, bodies), unanchored)
    return found.select("chapter_no", md5("text").alias("script"))


CHAPTER_SCRIPTS = rf"""
WITH {_ANCHORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY ord, pos) AS k FROM used),
readers AS (SELECT ord, note_ord, note_id FROM ranked JOIN notes USING (note_id) WHERE k = 1),
parts AS (
  SELECT ord // 10 AS chapter_no, 0 AS a, ord AS b, -1 AS c, regexp_replace(regexp_replace(a.text, '\[\[FN:([^\]\s]+)\]\]', '', 'g'), '\[\^[^\]]+\]', '', 'g') AS part FROM anchored a
  UNION ALL SELECT ord // 10, 0, ord, note_ord, 'Poznámka: body of ' || note_id FROM readers
  UNION ALL SELECT (SELECT max(ord) // 10 FROM anchored), 1, range * 2, 0, 'Poznámka: free note' FROM range(40, 45))
SELECT chapter_no, md5(string_agg(part, chr(10) || chr(10) ORDER BY a, b, c)) AS script FROM parts GROUP BY chapter_no"""


def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that came in any order, each at the place of its item; equal items share one result."""
    items = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item"), F.sha2("text", 256).alias("key"), "conv_id", "turn")
    results = services.called(table(spark, sf_dir, "conversations").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"]), services.StandIn)
    return items.join(results.where("status = 'success'").select("key", "payload"), "key", "left").select("item", F.length("payload").cast("long").alias("n"), md5("payload").alias("payload"))


ORDERED_RESULTS = "SELECT conv_id || '-' || turn AS item, length(upper(replace(text, 'ß', 'SS'))) AS n, md5(upper(replace(text, 'ß', 'SS'))) AS payload FROM conversations"


def encoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as base64 and back, moments as UTC stamps, and words looked up, sliced and appended."""
    words = F.split("text", " ", -1)
    own = documents(spark, sf_dir).select("doc_id", F.base64(F.col("text").cast("binary")).alias("b"), words.alias("w"), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("stamp"))
    # Spark breaks base64 into lines of 76 signs, as MIME has it
    return own.select("doc_id", md5(F.regexp_replace("b", r"\s", "")).alias("encoded"), md5(F.unbase64("b").cast("string")).alias("decoded"), "stamp", F.array_contains("w", "the").alias("has"), F.array_join(F.array_append(F.slice("w", 1, 3), F.lit("end")), "|").alias("first"))


ENCODED_BYTES = """
SELECT doc_id, md5(to_base64(encode(text))) AS encoded, md5(text) AS decoded, strftime(to_timestamp(1700000000 + doc_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp,
  list_contains(string_split(text, ' '), 'the') AS has, array_to_string(list_append(string_split(text, ' ')[1:3], 'end'), '|') AS first
FROM documents"""


_queries = dict(
    pending_stages=(pending_stages, PENDING_STAGES),
    paired_sources=(paired_sources, PAIRED_SOURCES),
    called_texts=(called_texts, CALLED_TEXTS),
    reduction_requests=(reduction_requests, REDUCTION_REQUESTS),
    reduction_signatures=(reduction_signatures, REDUCTION_SIGNATURES),
    chapter_scripts=(chapter_scripts, CHAPTER_SCRIPTS),
    ordered_results=(ordered_results, ORDERED_RESULTS),
    encoded_bytes=(encoded_bytes, ENCODED_BYTES),
)
QUERIES = {k: q for k, (q, _) in _queries.items()}
ORACLES = {k: s for k, (_, s) in _queries.items() if s}
