"""Queries on texts: words, paragraphs, anchors, packing, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import contracts, metrics, notes, overlay, packing, segment, speech


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def longs(df: DataFrame) -> DataFrame:
    """df with every whole number as a long."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


LINES = """lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord
  FROM documents)"""
WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"


def md5(c: Column | str) -> Column:
    return F.md5(tx.column(c).cast("binary"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(documents(spark, sf_dir).select("doc_id", tx.word_count("text").alias("n_words"), F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes")))


def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(metrics.source_statistics(lines(documents(spark, sf_dir)).withColumnRenamed("line", "text"), "source"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(documents(spark, sf_dir))
    whole = own.select(F.col("line").alias("text")).unionByName(own.select(F.upper(F.replace("line", F.lit("ß"), F.lit("ss"))).alias("text"))).unionByName(own.select(F.concat(F.lit("## "), "line").alias("text")))
    named = own.select(F.concat(F.lit("Chapter "), (F.col("ord") + 1).cast("string")).alias("text")).unionByName(own.select((F.col("ord") + 1).cast("string").alias("text")))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("text")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("text")))
    return whole.unionByName(named).unionByName(names).where("trim(text) <> ''").distinct().select("text", tx.is_heading("text").alias("heading"))


HEADINGS = rf"""
WITH {LINES},
texts AS (
  SELECT line AS text FROM lines UNION SELECT upper(replace(line, 'ß', 'ss')) FROM lines UNION SELECT '## ' || line FROM lines
  UNION SELECT 'Chapter ' || (ord + 1) FROM lines UNION SELECT CAST(ord + 1 AS VARCHAR) FROM lines
  UNION SELECT r_name FROM region UNION SELECT n_name FROM nation),
cut AS (SELECT text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM texts WHERE trim(text) <> '')
SELECT text, CASE
  WHEN length(p) > 80 THEN false
  WHEN p LIKE '## %' THEN NOT regexp_matches(substr(p, 4), '[!?][''’”"]?\s+\S')
  WHEN regexp_matches(p, '^[„“”"''‘’«»]') THEN false
  ELSE regexp_matches(p, '^(?i:##\s+.+|(?:{tx.CHAPTER_WORDS})\b[\s.:]*\w*.{{0,60}}|[IVXLC]+\.?|\d{{1,3}}\.?)$')
    OR (length(regexp_replace(p, '\P{{L}}', '', 'g')) >= 2 AND length(p) <= 40 AND regexp_matches(regexp_replace(p, '\P{{L}}', '', 'g'), '^\p{{Lu}}+$')
        AND NOT regexp_matches(regexp_replace(p, '^[„“”"''‘’«» ]+|[„“”"''‘’«» ]+$', '', 'g'), '[.,!?:;]$')) END AS heading
FROM cut"""


def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.split(F.regexp_replace("text", "e ", "e-\n"), "\n")
    return documents(spark, sf_dir).select("doc_id", md5(tx.join_hyphenated(broken)).alias("joined"))


DEHYPHENATED = r"""
SELECT doc_id, md5(replace(regexp_replace(replace(text, 'e ', 'e-' || chr(10)), '-\n(\p{Ll})', '\1', 'g'), chr(10), ' ')) AS joined
FROM documents"""


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tx.split_paragraphs(F.replace("text", F.lit(".\n"), F.lit(".\n \n")))
    return longs(documents(spark, sf_dir).select("doc_id", F.size(parts).alias("n_paragraphs"), md5(F.array_join(parts, "|")).alias("paragraphs")))


PARAGRAPH_SPLIT = r"""
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'),
    lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')),
    lambda p: p <> '') AS p
  FROM documents)
SELECT doc_id, len(p) AS n_paragraphs, md5(array_to_string(p, '|')) AS paragraphs FROM parts"""


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(documents(spark, sf_dir))
    region = F.when(F.col("ord") == 0, F.lit("header")).otherwise(F.lit("footer"))
    found = metrics.repeated_margins(own.select(F.col("lang").alias("book"), F.col("doc_id").alias("page_no"), region.alias("region"), F.col("line").alias("text")))
    return longs(found)


MARGIN_KEY = r"replace(lower(regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '\d+', '#', 'g')), 'ß', 'ss')"
MARGINS = rf"""
WITH {LINES},
keyed AS (SELECT lang AS book, doc_id, ord, line, {MARGIN_KEY.format('line')} AS key FROM lines),
counts AS (SELECT book, key, count(DISTINCT doc_id) AS n FROM keyed
  WHERE key <> '' AND key <> '#' AND length(key) <= 120 AND NOT (ord > 0 AND regexp_matches(line, '^\s*(?:\d{{1,3}}|[*†‡§]+)[.)]?\s*\D')) GROUP BY ALL),
pages AS (SELECT book, count(DISTINCT doc_id) AS pages FROM keyed GROUP BY ALL)
SELECT book, key, n FROM counts JOIN pages USING (book) WHERE n >= greatest(3, pages * 0.15)"""


def margin_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(documents(spark, sf_dir)).groupBy(md5(tx.margin_key("line")).alias("key")).agg(F.count("*").alias("n"))


MARGIN_KEYS = f"WITH {LINES} SELECT md5({MARGIN_KEY.format('line')}) AS key, count(*) AS n FROM lines GROUP BY ALL"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks of books by language: some documents' first lines are headings, some begin small, some lack stops."""
    own = lines(documents(spark, sf_dir))
    text = F.when(F.col("doc_id") % 3 == 0, F.lower("line")).otherwise(F.col("line"))
    text = F.when(F.col("doc_id") % 4 == 0, F.rtrim(F.translate(text, ".!?:;", "     "))).otherwise(text)
    kind = F.when((F.col("ord") == 0) & (F.col("doc_id") % 7 == 0), F.lit("heading")).otherwise(F.lit("paragraph"))
    return own.select(F.col("lang").alias("book"), F.col("doc_id").alias("page_no"), "ord", kind.alias("type"), text.alias("text"))


def book_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.paragraphs(_blocks(spark, sf_dir))
    return longs(found.select("book", "chapter_no", "number", "id", md5("text").alias("text"), "source_page", F.size("source_pages").alias("n_pages")))


IS_HEADING = HEADINGS[HEADINGS.index("CASE"):HEADINGS.index(" AS heading")]
_BLOCKS = rf"""{LINES},
derived AS (
  SELECT lang AS book, doc_id AS page_no, ord, CASE WHEN ord = 0 AND doc_id % 7 = 0 THEN 'heading' ELSE 'paragraph' END AS type,
    CASE WHEN doc_id % 3 = 0 THEN lower(line) ELSE line END AS t FROM lines),
blocks AS (
  SELECT book, page_no, ord, type, CASE WHEN page_no % 4 = 0 THEN rtrim(translate(t, '.!?:;', '     ')) ELSE t END AS text FROM derived)"""
BOOK_PARAGRAPHS = rf"""
WITH {_BLOCKS},
stripped AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM blocks),
flagged AS (SELECT *, type = 'heading' OR ({IS_HEADING}) AS heading FROM stripped WHERE p <> ''),
numbered AS (
  SELECT *, sum(CAST(heading AS INT)) OVER b + CASE WHEN first(heading) OVER b THEN 0 ELSE 1 END AS chapter_no,
    row_number() OVER (PARTITION BY book, page_no ORDER BY ord) = 1 AS opens
  FROM flagged WINDOW b AS (PARTITION BY book ORDER BY page_no, ord)),
prose AS (SELECT *, regexp_replace(regexp_replace(p, '^[# ]+', ''), '^\s+|\s+$', '', 'g') AS q FROM numbered WHERE NOT heading),
joined AS (
  SELECT *, opens AND coalesce(regexp_matches(q, '^\p{{Ll}}') AND NOT regexp_matches(lag(q) OVER c, '[.!?:;][”"’]?$'), false) AS goes_on
  FROM prose WINDOW c AS (PARTITION BY book, chapter_no ORDER BY page_no, ord)),
counted AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY book, chapter_no ORDER BY page_no, ord) AS number FROM joined)
SELECT book, CAST(chapter_no AS BIGINT) AS chapter_no, CAST(number AS BIGINT) AS number,
  printf('ch%02d-p%03d', CAST(chapter_no AS BIGINT), CAST(number AS BIGINT)) AS id,
  md5(string_agg(q, ' ' ORDER BY page_no, ord)) AS text, min(page_no) AS source_page, count(DISTINCT page_no) AS n_pages
FROM counted GROUP BY book, chapter_no, number"""


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("source", "doc_id", tx.word_count("text").alias("words"))
    packed = packing.pack(own, packing.CHUNK_WORDS, "source", "doc_id")
    return longs(packed.groupBy("source", "chunk").agg(F.count("*").alias("n_paragraphs"), F.sum("words").alias("n_words"), F.min("doc_id").alias("first_id")))


GREEDY_PACK = rf"""
WITH RECURSIVE own AS (
  SELECT source, doc_id, {WORDS.format('text')} AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
packed AS (
  SELECT source, k, doc_id, n, 0 AS chunk, n AS held FROM own WHERE k = 1
  UNION ALL
  SELECT o.source, o.k, o.doc_id, o.n, CASE WHEN p.held + o.n > 1200 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.held + o.n > 1200 THEN o.n ELSE p.held + o.n END
  FROM packed p JOIN own o ON o.source = p.source AND o.k = p.k + 1)
SELECT source, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_paragraphs, CAST(sum(n) AS BIGINT) AS n_words, min(doc_id) AS first_id
FROM packed GROUP BY source, chunk"""


def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("chunk"), "text")
    found = packing.with_context(turns, n_words=40)
    return found.select("chapter", "chunk", md5("context_before").alias("before"), md5("context_after").alias("after"))


_FIRST = r"array_to_string(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')[1:40], ' ')"
_LAST = r"array_to_string(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')[-40:], ' ')"
CHUNK_CONTEXT = f"""
SELECT conv_id AS chapter, turn AS chunk,
  md5(coalesce({_LAST.format('lag(text) OVER w')}, '')) AS before, md5(coalesce({_FIRST.format('lead(text) OVER w')}, '')) AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def speech_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return speech.with_neighbours(turns, "conv_id", "turn").select("conv_id", "turn", md5("previous_text").alias("before"), md5("future_text").alias("after"))


SPEECH_CONTEXT = """
SELECT conv_id, turn, md5(coalesce(right(lag(text) OVER w, 100), '')) AS before, md5(coalesce(left(lead(text) OVER w, 100), '')) AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def synopses_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chapter_ord"), F.col("text").alias("synopsis"))
    return packing.around(docs.select("chapter_ord"), docs).select(F.col("chapter_ord").alias("doc_id"), md5("synopses").alias("synopses"))


SYNOPSES_AROUND = """
SELECT a.doc_id, md5(string_agg(b.text, chr(10) ORDER BY b.doc_id)) AS synopses
FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id - 1 AND a.doc_id + 1 GROUP BY a.doc_id"""


def split_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(speech.split("text", max_chars=1800)).alias("number", "chunk"))
    return longs(rows.select("doc_id", "number", F.length("chunk").alias("n_chars"), md5("chunk").alias("chunk")))


SPLIT_CHARS = r"""
WITH RECURSIVE own AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
steps AS (
  SELECT doc_id, -1 AS number, '' AS chunk, t AS rest FROM own WHERE t <> ''
  UNION ALL
  SELECT doc_id, number + 1, trim(left(rest, cut)), ltrim(substr(rest, cut + 1)) FROM (
    SELECT doc_id, number, rest, CASE WHEN length(rest) <= 1800 THEN length(rest)
      WHEN regexp_matches(left(rest, 1800), '[.!?…]["''”’»)]?\s') THEN length(regexp_extract(left(rest, 1800), '^((?s:.*)[.!?…]["''”’»)]?\s+)', 1))
      WHEN instr(left(rest, 1800), ' ') > 1 THEN 1800 - instr(reverse(left(rest, 1800)), ' ')
      ELSE 1800 END AS cut
    FROM steps WHERE rest <> ''))
SELECT doc_id, CAST(number AS BIGINT) AS number, length(chunk) AS n_chars, md5(chunk) AS chunk FROM steps WHERE number >= 0"""


def split_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(speech.split("text", max_chars=2000, max_bytes=900)).alias("number", "chunk"))
    return longs(rows.select("doc_id", "number", F.octet_length("chunk").alias("n_bytes"), md5("chunk").alias("chunk")))


SPLIT_BYTES = SPLIT_CHARS.replace("1800", "most").replace("SELECT doc_id, number, rest, CASE", "SELECT doc_id, number, rest, least(2000, list_max(list_filter(range(0, 901), lambda k: strlen(left(rest, k)) <= 900))) AS most, CASE")
SPLIT_BYTES = SPLIT_BYTES.replace("length(chunk) AS n_chars", "strlen(chunk) AS n_bytes")


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document with anchors of two notes behind it; notes are fn-p0000-000 to fn-p0039-000."""
    mark = lambda n: F.concat(F.lit("[[FN:fn-p"), F.lpad(n.cast("string"), 4, "0"), F.lit("-000]]"))
    text = F.concat("text", mark(F.col("doc_id") % 50), F.lit(" x "), mark((F.col("doc_id") * 7) % 50))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), text.alias("text"))


def _notes(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.format_string("fn-p%04d-000", F.col("id").cast("int")).alias("note_id"), (40 - F.col("id")).alias("note_ord"))


_ANCHORED = """anchored AS (
  SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id,
    text || '[[FN:fn-p' || lpad(CAST(doc_id % 50 AS VARCHAR), 4, '0') || '-000]] x [[FN:fn-p' || lpad(CAST((doc_id * 7) % 50 AS VARCHAR), 4, '0') || '-000]]' AS text
  FROM documents),
notes AS (SELECT printf('fn-p%04d-000', range) AS note_id, 40 - range AS note_ord FROM range(40)),
used AS (
  SELECT ord, id, unnest(regexp_extract_all(text, '\\[\\[FN:([\\w.-]+)\\]\\]', 1)) AS note_id, unnest([0, 1]) AS pos FROM anchored)""".replace("\\\\", "\\")


def first_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(notes.references(_anchored(spark, sf_dir)))


FIRST_REFERENCES = f"""
WITH {_ANCHORED}
SELECT ord, id, CAST(pos AS BIGINT) AS pos, note_id, row_number() OVER (PARTITION BY note_id ORDER BY ord, pos) = 1 AS first FROM used"""


def dangling_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.dangling(_anchored(spark, sf_dir), _notes(spark))


DANGLING_ANCHORS = f"WITH {_ANCHORED} SELECT DISTINCT id, note_id FROM used WHERE note_id NOT IN (SELECT note_id FROM notes)"


def note_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(notes.readers(_anchored(spark, sf_dir), _notes(spark)))


NOTE_READERS = f"""
WITH {_ANCHORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY ord, pos) AS k FROM used)
SELECT ord, id, row_number() OVER (PARTITION BY ord ORDER BY note_ord) AS turn, note_id FROM ranked JOIN notes USING (note_id) WHERE k = 1"""


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored texts with faults: some missing, blank, without an anchor, or with anchors the other way round."""
    own = _anchored(spark, sf_dir).where("ord % 13 <> 5")
    turned = F.regexp_replace("text", r"(\[\[FN:[^\]]+\]\])(.*)(\[\[FN:[^\]]+\]\])", "$3$2$1")
    text = F.when(F.col("ord") % 11 == 3, F.lit(" ")).when(F.col("ord") % 11 == 4, tx.without_anchors("text")).when(F.col("ord") % 11 == 5, turned).otherwise(F.col("text"))
    extra = own.where("ord % 17 = 1").withColumn("id", F.concat(F.lit("x"), "id"))
    return own.withColumn("text", text).unionByName(extra)


_TRANSLATED = r"""translated AS (
  SELECT ord, id, CASE ord % 11 WHEN 3 THEN ' ' WHEN 4 THEN regexp_replace(text, '\[\[FN:([^\]\s]+)\]\]', '', 'g')
    WHEN 5 THEN regexp_replace(text, '(\[\[FN:[^\]]+\]\])(.*)(\[\[FN:[^\]]+\]\])', '\3\2\1') ELSE text END AS text FROM anchored WHERE ord % 13 <> 5
  UNION ALL SELECT ord, 'x' || id, text FROM anchored WHERE ord % 13 <> 5 AND ord % 17 = 1),
pairs AS (
  SELECT a.id, a.text AS s, t.text AS t, regexp_extract_all(a.text, '\[\[FN:([^\]\s]+)\]\]', 1) AS sa, regexp_extract_all(t.text, '\[\[FN:([^\]\s]+)\]\]', 1) AS ta
  FROM anchored a JOIN translated t USING (id))"""


def text_map_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.text_map_violations(_anchored(spark, sf_dir), _translated(spark, sf_dir))


TEXT_MAP_VIOLATIONS = rf"""
WITH {_ANCHORED}, {_TRANSLATED}
SELECT id, 'missing' AS problem FROM anchored WHERE id NOT IN (SELECT id FROM translated)
UNION ALL SELECT id, 'extra' FROM translated WHERE id NOT IN (SELECT id FROM anchored)
UNION ALL SELECT id, 'blank' FROM pairs WHERE trim(t) = ''
UNION ALL SELECT id, 'anchors' FROM pairs WHERE sa <> ta
UNION ALL SELECT id, 'immutable' FROM pairs WHERE s <> t AND NOT regexp_matches(regexp_replace(s, '\[\[FN:([^\]\s]+)\]\]', '', 'g'), '\p{{L}}')"""


def anchor_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.anchors_kept(_anchored(spark, sf_dir), _translated(spark, sf_dir))


ANCHOR_MULTISETS = rf"""
WITH {_ANCHORED}, {_TRANSLATED}
SELECT a.id FROM anchored a LEFT JOIN translated t USING (id)
WHERE list_sort(regexp_extract_all(a.text, '\[\[FN:([\w.-]+)\]\]', 1)) <> list_sort(regexp_extract_all(coalesce(t.text, ''), '\[\[FN:([\w.-]+)\]\]', 1))"""


def immutable_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(documents(spark, sf_dir)).select("doc_id", "ord", F.when(F.col("ord") % 5 == 0, F.regexp_replace("line", r"\p{L}", "")).otherwise(F.col("line")).alias("text"))
    return longs(own.where(tx.is_immutable("text")).select("doc_id", "ord", md5("text").alias("text")))


IMMUTABLE_ENTRIES = rf"""
WITH {LINES}, own AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 0 THEN regexp_replace(line, '\p{{L}}', '', 'g') ELSE line END AS text FROM lines)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, md5(text) AS text FROM own WHERE NOT regexp_matches(regexp_replace(text, '\[\[FN:([^\]\s]+)\]\]', '', 'g'), '\p{{L}}')"""


def restored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lines(documents(spark, sf_dir)).select(F.struct("doc_id", "ord").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("line", r"\p{L}", "")).otherwise(F.col("line")).alias("text"))
    output = source.select("id", F.concat(F.col("text"), F.lit("!")).alias("text"))
    return contracts.restored(source, output).select(F.col("id.doc_id").alias("id"), md5("text").alias("text"))


RESTORED_ENTRIES = rf"""
WITH {LINES}, own AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(line, '\p{{L}}', '', 'g') ELSE line END AS text FROM lines)
SELECT id, md5(CASE WHEN regexp_matches(text, '\p{{L}}') THEN text || '!' ELSE text END) AS text FROM own"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id")).distinct()
    return contracts.coverage(documents(spark, sf_dir).select("doc_id"), labels, "doc_id")


COVERAGE = """
SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels)
UNION ALL SELECT DISTINCT doc_id * 2, 'extra' FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("patch "), F.col("doc_id").cast("string")))
    return labels.select((F.col("doc_id") * F.when(F.col("doc_id") % 5 == 0, F.lit(1000003)).otherwise(F.lit(1))).alias("id"), text.alias("text"))


def patch_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = overlay.overlay(docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id")), docs.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("id"), "text"), _patches(spark, sf_dir))
    return found.select("id", md5("text").alias("text"))


_PATCHES = "patches AS (SELECT doc_id * CASE WHEN doc_id % 5 = 0 THEN 1000003 ELSE 1 END AS id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE 'patch ' || doc_id END AS text FROM labels)"
PATCH_OVERLAY = f"""
WITH {_PATCHES}
SELECT d.doc_id AS id, md5(coalesce(p.text, CASE WHEN d.doc_id % 10 <> 7 THEN d.text END)) AS text
FROM documents d LEFT JOIN patches p ON p.id = d.doc_id AND trim(p.text) <> ''"""


def missing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = overlay.overlay(docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id")), docs.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("id"), "text"), _patches(spark, sf_dir))
    return overlay.missing(found)


MISSING_TEXTS = f"""
WITH {_PATCHES}
SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 7 AND doc_id NOT IN (SELECT id FROM patches WHERE trim(text) <> '')"""


def changed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return overlay.changed(docs, docs.select("id", F.replace("text", F.lit("ing"), F.lit("in")).alias("text"))).select("id", md5("text").alias("text"))


CHANGED_TEXTS = "SELECT doc_id AS id, md5(replace(text, 'ing', 'in')) AS text FROM documents WHERE instr(text, 'ing') > 0"


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(documents(spark, sf_dir))
    return longs(own.select("doc_id", "ord", md5(tx.escape_markup("line")).alias("markup"), md5(tx.escape_metadata("line")).alias("metadata"), md5(tx.safe_name("line")).alias("name"), md5(tx.safe_name("line", audio=True)).alias("audio_name")))


ESCAPED_TEXTS = rf"""
WITH {LINES}
SELECT doc_id, CAST(ord AS BIGINT) AS ord, md5(regexp_replace(line, '([\\#$*_`\[\]<>@~=/])', '\\\1', 'g')) AS markup,
  md5(replace(replace(replace(translate(replace(line, '\', '\\'), chr(10) || chr(13), '  '), '=', '\='), ';', '\;'), '#', '\#')) AS metadata,
  md5(coalesce(nullif(regexp_replace(regexp_replace(line, '[\\/:*?"<>|]+', '', 'g'), '^\s+|\s+$', '', 'g'), ''), 'kniha')) AS name,
  md5(coalesce(nullif(left(regexp_replace(regexp_replace(line, '[\\/:*?"<>|\x00-\x1f]+', '', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120), ''), 'kniha')) AS audio_name
FROM lines"""


def spoken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _anchored(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" see [^1] end")))
    return own.select("id", tx.spoken("text").alias("text"))


SPOKEN_TEXTS = rf"""
WITH {_ANCHORED}
SELECT id, regexp_replace(regexp_replace(text || ' see [^1] end', '\[\[FN:([^\]\s]+)\]\]', '', 'g'), '\[\^[^\]]+\]', '', 'g') AS text FROM anchored"""


def utf8_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.utf8_prefix("text", 97).alias("prefix"))


UTF8_PREFIXES = """
SELECT doc_id, left(text, list_max(list_filter(range(0, 98), lambda k: strlen(left(text, k)) <= 97))) AS prefix FROM documents"""


def unanimous_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).cast("long").alias("book"), "lang")
    return segment.unanimous(pairs)


UNANIMOUS_LANGUAGE = """
SELECT doc_id // 2 AS book, CASE WHEN count(DISTINCT lang) = 1 THEN max(lang) ELSE 'unknown' END AS lang FROM documents GROUP BY 1"""


def language_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("book"), F.lit(1).alias("page_no"), F.lit(0).alias("ord"), F.lit("paragraph").alias("type"), "text")
    return longs(segment.language_samples(blocks).select("book", "sample_no", md5("sample").alias("sample")))


LANGUAGE_SAMPLES = rf"""
WITH own AS (SELECT CAST(doc_id AS VARCHAR) AS book, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
prose AS (SELECT book, t FROM (SELECT book, t, t AS p FROM own) WHERE t <> '' AND NOT ({IS_HEADING})),
starts AS (SELECT book, t, unnest(CASE WHEN length(t) <= 2000 THEN [0] ELSE [0, (length(t) - 2000) // 2, length(t) - 2000] END) AS s,
  unnest(CASE WHEN length(t) <= 2000 THEN [0] ELSE [0, 1, 2] END) AS k FROM prose)
SELECT book, CAST(k AS BIGINT) AS sample_no, md5(substr(t, s + 1, 2000)) AS sample FROM starts"""


def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(documents(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars")).orderBy(F.desc("n_chars"), "doc_id").limit(20))


LONGEST_DOCUMENTS = "SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20"


def problem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(contracts.sample_ids(contracts.text_map_violations(_anchored(spark, sf_dir), _translated(spark, sf_dir)).select("problem", "id")))


PROBLEM_SAMPLES = rf"""
WITH found AS (SELECT DISTINCT problem, id FROM ({TEXT_MAP_VIOLATIONS})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY id) AS k FROM found)
SELECT problem, count(*) AS n, string_agg(CASE WHEN k <= 8 THEN id END, ',' ORDER BY id) AS sample FROM ranked GROUP BY problem"""


def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    entries = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("ch"), F.col("lang")).alias("chapter"), F.when(F.col("doc_id") % 29 == 3, F.lit("note")).otherwise(F.lit("paragraph")).alias("kind"), "text")
    found = packing.book_chunks(entries)
    return longs(found.select("chunk_key", "kind", "n_paragraphs", "words", md5("text").alias("text"), md5("context_before").alias("before"), md5("context_after").alias("after")))


BOOK_CHUNKS = rf"""
WITH RECURSIVE own AS (
  SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN 'footnotes' ELSE 'ch' || lang END AS chapter, text, {WORDS.format('text')} AS n FROM documents),
ordered AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY doc_id) AS k FROM own),
packed AS (
  SELECT chapter, k, doc_id, n, 0 AS chunk, n AS held FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.chapter, o.k, o.doc_id, o.n, CASE WHEN p.held + o.n > 1200 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.held + o.n > 1200 THEN o.n ELSE p.held + o.n END
  FROM packed p JOIN ordered o ON o.chapter = p.chapter AND o.k = p.k + 1),
chunks AS (
  SELECT p.chapter, p.chunk, count(*) AS n_paragraphs, CAST(sum(p.n) AS BIGINT) AS words, string_agg(o.text, chr(10) || chr(10) ORDER BY p.doc_id) AS text
  FROM packed p JOIN own o USING (doc_id) GROUP BY p.chapter, p.chunk)
SELECT chapter || '-' || chunk AS chunk_key, CASE WHEN chapter = 'footnotes' THEN 'footnotes' ELSE 'prose' END AS kind, n_paragraphs, words, md5(text) AS text,
  md5(coalesce({_LAST.format('lag(text) OVER w').replace('40', '400')}, '')) AS before, md5(coalesce({_FIRST.format('lead(text) OVER w').replace('40', '400')}, '')) AS after
FROM chunks WINDOW w AS (PARTITION BY chapter ORDER BY chunk)"""


_queries = dict(
    word_counts=(word_counts, f"SELECT doc_id, {WORDS.format('text')} AS n_words, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents"),
    source_statistics=(source_statistics, f"WITH {LINES} SELECT source, count(*) AS n_paragraphs, CAST(sum({WORDS.format('line')}) AS BIGINT) AS n_words, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY source"),
    heading_predicate=(headings, HEADINGS),
    dehyphenate_lines=(dehyphenated, DEHYPHENATED),
    split_paragraphs=(paragraph_split, PARAGRAPH_SPLIT),
    repeated_margins=(margins, MARGINS),
    margin_keys=(margin_keys, MARGIN_KEYS),
    book_paragraphs=(book_paragraphs, BOOK_PARAGRAPHS),
    greedy_pack_1200=(greedy_pack, GREEDY_PACK),
    book_chunks=(book_chunks, BOOK_CHUNKS),
    chunk_context=(chunk_context, CHUNK_CONTEXT),
    speech_context=(speech_context, SPEECH_CONTEXT),
    band_join_synopses=(synopses_around, SYNOPSES_AROUND),
    split_text_1800=(split_chars, SPLIT_CHARS),
    split_text_bytes=(split_bytes, SPLIT_BYTES),
    first_references=(first_references, FIRST_REFERENCES),
    dangling_anchors=(dangling_anchors, DANGLING_ANCHORS),
    note_readers=(note_readers, NOTE_READERS),
    text_map_violations=(text_map_violations, TEXT_MAP_VIOLATIONS),
    problem_samples=(problem_samples, PROBLEM_SAMPLES),
    anchor_multisets=(anchor_multisets, ANCHOR_MULTISETS),
    immutable_entries=(immutable_entries, IMMUTABLE_ENTRIES),
    restored_entries=(restored_entries, RESTORED_ENTRIES),
    coverage_problems=(coverage, COVERAGE),
    patch_overlay=(patch_overlay, PATCH_OVERLAY),
    missing_texts=(missing_texts, MISSING_TEXTS),
    changed_texts=(changed_texts, CHANGED_TEXTS),
    escaped_texts=(escaped_texts, ESCAPED_TEXTS),
    spoken_texts=(spoken_texts, SPOKEN_TEXTS),
    utf8_prefixes=(utf8_prefixes, UTF8_PREFIXES),
    language_vote=(unanimous_language, UNANIMOUS_LANGUAGE),
    language_samples=(language_samples, LANGUAGE_SAMPLES),
    order_and_topk=(longest_documents, LONGEST_DOCUMENTS),
)
QUERIES = {k: q for k, (q, _) in _queries.items()}
ORACLES = {k: s for k, (_, s) in _queries.items() if s}
