"""What belongs to what on a page: images to paragraphs, links to definitions and lines, boxes to boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as geo
from leafmill.functions import ids
from leafmill.operators import asof

SAME_NOTE, SAME_FIGURE = 0.8, 0.75


def place_images(images: DataFrame, paragraphs: DataFrame, units: DataFrame) -> DataFrame:
    """image_id, placement, target of each image (image_id, page_no, top).

    paragraphs: ord, id, page_no (a row for each page it is on), first_page, bottom
    (null if unknown); units: ord, id, page_no, kind (before_heading or
    before_paragraph). An image follows the last paragraph of its page that ends
    above it, else it precedes the page's first; on a page without paragraphs it
    follows the last earlier one, else it precedes the first unit from its page on.
    """
    above = F.coalesce(F.col("bottom") <= F.col("top") + 2, F.lit(False))
    on_page = images.join(paragraphs, "page_no").groupBy("image_id").agg(
        F.max_by(F.when(above, F.col("id")), F.when(above, F.col("ord"))).alias("above"),
        F.min_by("id", "ord").alias("first"),
    )
    # nearest earlier and next pages come from a row for each page, not from a range join
    starts = paragraphs.groupBy(F.col("first_page").alias("page_no")).agg(F.max_by("id", "ord").alias("last_id"))
    nexts = units.groupBy("page_no").agg(F.min_by(F.struct("id", "kind"), "ord").alias("unit"))
    pages = images.select("page_no").distinct().unionByName(starts.select("page_no")).unionByName(nexts.select("page_no")).distinct()
    pages = pages.join(starts, "page_no", "left").join(nexts, "page_no", "left")
    around = asof.nearest(asof.nearest(pages, "page_no", "last_id", "earlier"), "page_no", "unit", "next", after=True, itself=True)
    around = around.select("page_no", "earlier", "next")
    out = images.join(on_page, "image_id", "left").join(around, "page_no", "left")
    placement = (
        F.when(F.col("above").isNotNull(), F.lit("after_paragraph")).when(F.col("first").isNotNull(), F.lit("before_paragraph"))
        .when(F.col("earlier").isNotNull(), F.lit("after_paragraph")).otherwise(F.col("next.kind"))
    )
    return out.select("image_id", placement.alias("placement"), F.coalesce("above", "first", "earlier", "next.id").alias("target"))


def shown_images(images: DataFrame) -> DataFrame:
    """Images that are shown: each once, at its first place, and no covers or backgrounds."""
    own = images.where(~F.col("role").isin("scan_background", "cover_artwork"))
    return own.groupBy("image_id").agg(F.min("ord").alias("ord"))


def link_definitions(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references with the definition that each links to: ref_id, def_id.

    references: ref_id, label, page_no, dest_page, dest_y, dest_x, x0, top;
    definitions: def_id, label, page_no, top, x0, back_page, back_x, back_y (where it
    points back to, or null). Candidates have the label and page that the link names.
    Those that point back at it come first, and a label of letters needs one; then
    those up to 25 points below the destination; then the nearest.
    """
    both = references.alias("r").join(definitions.alias("d"), (F.col("r.dest_page") == F.col("d.page_no")) & (F.col("r.label") == F.col("d.label")))
    back = F.coalesce((F.col("d.back_page") == F.col("r.page_no")) & (F.abs(F.col("d.back_x") - F.col("r.x0")) < 3) & (F.abs(F.col("d.back_y") - F.col("r.top")) < 20), F.lit(False))
    sure = back | F.col("r.label").rlike(r"^(?:\d{1,3}|[*†‡§]+)$")
    below = F.col("d.top").between(F.col("r.dest_y") - 1, F.col("r.dest_y") + 25)
    far = F.abs(F.col("d.top") - F.col("r.dest_y")) + F.abs(F.col("d.x0") - F.col("r.dest_x"))
    order = F.struct((~back).alias("a"), (~below).alias("b"), far.alias("c"), F.col("d.def_id").alias("d"))
    return both.where(sure).groupBy(F.col("r.ref_id").alias("ref_id")).agg(F.min_by(F.col("d.def_id"), order).alias("def_id"))


def number_definitions(definitions: DataFrame) -> DataFrame:
    """definitions with note_id, by their places on the page."""
    place = F.row_number().over(Window.partitionBy("page_no").orderBy("top", "x0"))
    return definitions.withColumn("note_id", ids.note_id(F.col("page_no"), place))


def first_line_hit(annotations: DataFrame, lines: DataFrame) -> DataFrame:
    """annotation_id, line_no: the first line (page_no, line_no, box) of its page that an annotation (page_no, annotation_id, box) overlaps."""
    both = annotations.alias("a").join(lines.alias("l"), "page_no").where(geo.overlaps(F.col("l.box"), F.col("a.box")))
    return both.groupBy("annotation_id").agg(F.min("line_no").alias("line_no"))


def glyphs_in(annotations: DataFrame, glyphs: DataFrame, slack: float = 0.3) -> DataFrame:
    """annotation_id, glyph_id of glyphs (page_no, glyph_id, box) within an annotation's columns that touch its rows."""
    a, g = F.col("a.box"), F.col("g.box")
    inside = (g.x0 >= a.x0 - slack) & (g.x1 <= a.x1 + slack) & (g.top < a.bottom) & (g.bottom > a.top)
    return annotations.alias("a").join(glyphs.alias("g"), "page_no").where(inside).select("annotation_id", "glyph_id")


def outside_of(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """boxes (page_no, box) that lie in none of their page's frames (page_no, box)."""
    own = frames.select("page_no", F.col("box").alias("_frame"))
    return boxes.join(own, (boxes.page_no == own.page_no) & geo.contains(F.col("_frame"), F.col("box")), "left_anti")


def drawn(boxes: DataFrame) -> DataFrame:
    """boxes (page_no, box, page_width, page_height) of drawings: no rules, no backgrounds."""
    b = F.col("box")
    return boxes.where((geo.width(b) >= 0.5) & (geo.height(b) >= 0.5) & (geo.area(b) <= F.col("page_width") * F.col("page_height") * 0.85))


def note_classes(notes: DataFrame) -> DataFrame:
    """note pairs (page_no, ord, other, verdict) with equal label and text on a page: `same`, `ambiguous` or `distinct`.

    notes: page_no, ord, label, text, box (null: unknown). The same place is one
    note; places that partly overlap, or are not known, cannot be told apart.
    """
    keyed = notes.withColumn("_text", F.regexp_replace("text", r"(?U)\s+", " "))
    a, b = keyed.alias("a"), keyed.alias("b")
    both = a.join(b, (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.label") == F.col("b.label")) & (F.col("a._text") == F.col("b._text")) & (F.col("a.ord") < F.col("b.ord")))
    unknown = F.col("a.box").isNull() | F.col("b.box").isNull()
    verdict = F.when(unknown, F.lit("ambiguous")).when(geo.likeness(F.col("a.box"), F.col("b.box")) >= SAME_NOTE, F.lit("same")).when(geo.common(F.col("a.box"), F.col("b.box")) > 0, F.lit("ambiguous")).otherwise(F.lit("distinct"))
    return both.select(F.col("a.page_no").alias("page_no"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("other"), verdict.alias("verdict"))


def figure_matches(figures: DataFrame, images: DataFrame) -> DataFrame:
    """page_no, figure_ord, image_ord: the first image of the page that a figure is nearly the same box as, else null."""
    own = images.select(F.col("page_no").alias("_page"), F.col("ord").alias("image_ord"), F.col("box").alias("_image"))
    same = (F.col("page_no") == F.col("_page")) & (geo.likeness(F.col("_image"), F.col("box"), 1.0) > SAME_FIGURE)
    return figures.join(own, same, "left").groupBy("page_no", F.col("ord").alias("figure_ord")).agg(F.min("image_ord").alias("image_ord"))


def separator_between(lines: DataFrame, separators: DataFrame) -> DataFrame:
    """page_no, y, line_no: the first line (page_no, line_no, top) below each separator (page_no, y)."""
    both = separators.join(lines, "page_no").where("top > y")
    return both.groupBy("page_no", "y").agg(F.min_by("line_no", F.struct("top", "line_no")).alias("line_no"))
