"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Note anchors: the narrow form is for layout and overlay, the wide one for contracts and narration.
NARROW_ANCHOR, WIDE_ANCHOR = r"(?U)\[\[FN:([\w.-]+)\]\]", r"\[\[FN:([^\]\s]+)\]\]"
# Words that begin a chapter heading, the forms of such headings, quotation marks, and signs that markup escapes.
CHAPTER_WORDS = "chapter|kapitola|kapitel|chapitre|capitolo|cap[ií]tulo|глава|rozdzia[łl]|fejezet|hoofdstuk"
CHAPTER_FORMS = rf"(?iuU)^(?:##\s+.+|(?:{CHAPTER_WORDS})\b[\s.:]*\w*.{{0,60}}|[IVXLC]+\.?|\d{{1,3}}\.?)$"
QUOTES = "„“”\"'‘’«»"
MARKUP_SIGNS = "\\#$*_`[]<>@~=/"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(column(c), SPACE, " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(column(c), SPACE), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def edge_words(c: Column | str, n: int, last: bool = False) -> Column:
    """The first, or last, n words with one space between them."""
    own = words(c)
    begin = F.greatest(F.size(own) - n + 1, F.lit(1)) if last else F.lit(1)
    return F.array_join(F.slice(own, begin, F.lit(n)), " ")


def join_hyphenated(lines: Column, lower_only: bool = True) -> Column:
    """Lines as one text. A hyphen at a line's end goes, with the break.

    lower_only: only before a small letter. Otherwise before anything, unless a
    space stands before the hyphen.
    """

    def step(text: Column, line: Column) -> Column:
        broken = text.endswith("-") & (line.rlike(r"^\p{Ll}") if lower_only else ~text.endswith(" -"))
        return F.when(broken, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)).when(text == "", line).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), step)


def split_paragraphs(c: Column | str) -> Column:
    """Paragraphs of a page: blank lines part them, broken lines are joined, empty ones go."""

    def whole(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, LINE_ENDS), strip), lambda line: line != "")
        return join_hyphenated(lines, lower_only=False)

    return F.filter(F.transform(F.split(column(c), r"(?U)\n\s*\n"), whole), lambda p: p != "")


def is_heading(c: Column | str) -> Column:
    """Whether a paragraph reads like a heading."""
    p = strip(c)
    letters = F.regexp_replace(p, r"\P{L}", "")
    core = F.regexp_replace(p, f"^[{QUOTES} ]+|[{QUOTES} ]+$", "")
    shouted = (F.length(letters) >= 2) & (F.length(p) <= 40) & letters.rlike(r"^\p{Lu}+$") & ~core.rlike(r"[.,!?:;]$")
    marked = ~F.substring(p, 4, 1 << 30).rlike("(?U)[!?]['’”\"]?\\s+\\S")
    return (
        F.when(F.length(p) > 80, F.lit(False))
        .when(p.startswith("## "), marked)
        .when(p.rlike(f"^[{QUOTES}]"), F.lit(False))
        .otherwise(p.rlike(CHAPTER_FORMS) | shouted)
    )


def heading_title(c: Column | str) -> Column:
    """Without leading number signs and spaces."""
    return strip(F.regexp_replace(column(c), "^[# ]+", ""))


def margin_key(c: Column | str) -> Column:
    """What running headers and footers have in common: digits become #, case is folded."""
    return F.replace(F.lower(F.regexp_replace(F.regexp_replace(strip(c), SPACE, " "), r"(?U)\d+", "#")), F.lit("ß"), F.lit("ss"))


def note_ids(c: Column | str, wide: bool = False) -> Column:
    """Ids of the note anchors in the text, in order."""
    return F.regexp_extract_all(column(c), F.lit(WIDE_ANCHOR if wide else NARROW_ANCHOR), F.lit(1))


def without_anchors(c: Column | str) -> Column:
    return F.regexp_replace(column(c), WIDE_ANCHOR, "")


def is_immutable(c: Column | str) -> Column:
    """Whether nothing but anchors holds a letter, so that a copy must be exact."""
    return ~without_anchors(c).rlike(r"\p{L}")


def spoken(c: Column | str) -> Column:
    """Without anchors and caret references, for narration."""
    return F.regexp_replace(without_anchors(c), r"\[\^[^\]]+\]", "")


def escape_markup(c: Column | str) -> Column:
    signs = "".join("\\" + s for s in MARKUP_SIGNS)
    return F.regexp_replace(column(c), f"([{signs}])", r"\\$1")


def escape_metadata(c: Column | str) -> Column:
    out = F.replace(column(c), F.lit("\\"), F.lit("\\\\"))
    out = F.translate(out, "\n\r", "  ")
    for sign in "=;#":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return out


def safe_name(c: Column | str, audio: bool = False) -> Column:
    """A file name. audio: no control signs either, no spaces or dots at the ends, 120 signs at most."""
    if audio:
        kept = F.substring(F.regexp_replace(F.regexp_replace(column(c), r"[\\/:*?\"<>|\x00-\x1f]+", ""), "^[ .]+|[ .]+$", ""), 1, 120)
    else:
        kept = strip(F.regexp_replace(column(c), r"[\\/:*?\"<>|]+", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("kniha"))


def without_fence(c: Column | str) -> Column:
    """A model's reply without the code fence around it."""
    text = strip(c)
    first_line = F.regexp_replace(text, r"^[^\n]*\n", "")
    return F.when(text.startswith("```"), strip(F.regexp_replace(first_line, r"(?s)```(?!.*```).*$", ""))).otherwise(text)


def utf8_prefix(c: Column | str, n_bytes: int) -> Column:
    """The longest beginning of at most n_bytes bytes that cuts no sign apart."""
    data = column(c).cast("binary")
    # a cut before a continuation byte falls inside a sign; a sign has four bytes at most

    def byte_after(k: int) -> Column:
        return F.conv(F.hex(F.substring(data, n_bytes - k + 1, 1)), 16, 10).cast("int")

    inside = [F.when((F.octet_length(column(c)) <= n_bytes) | byte_after(k).isNull() | ~byte_after(k).between(0x80, 0xBF), F.lit(k)) for k in range(4)]
    return F.decode(F.substring(data, F.lit(1), F.lit(n_bytes) - F.coalesce(*inside)), "UTF-8")


def link_label(c: Column | str) -> Column:
    """The label that a link's description names, such as 3 of "Footnote 3"; null if it names none."""
    own = F.regexp_extract(strip(c), r"(?iu)^(?:Footnote|Poznámka|Fußnote)\s+(\d{1,3}|[*†‡§]+|[A-Za-z]{1,8})$", 1)
    return F.nullif(own, F.lit(""))


def entries_json(entries: Column) -> Column:
    """A JSON object of ids to texts, in order, for a model to answer; entries: an array of id, text."""
    one = F.transform(entries, lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e.id.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(": "), F.regexp_extract(F.to_json(F.struct(e.text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)))
    return F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}"))
