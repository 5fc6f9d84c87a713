"""Boxes as structs of x0, top, x1, bottom, in points from the page's upper left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), top.cast("double").alias("top"), x1.cast("double").alias("x1"), bottom.cast("double").alias("bottom"))


def width(b: Column) -> Column:
    return b.x1 - b.x0


def height(b: Column) -> Column:
    return b.bottom - b.top


def area(b: Column) -> Column:
    return width(b) * height(b)


def common(a: Column, b: Column) -> Column:
    """The area that both boxes cover."""
    across = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    down = F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)
    return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)


def likeness(a: Column, b: Column, least_union: float = 0.0) -> Column:
    """Common area by joint area; the latter counts as least_union at least."""
    joint = area(a) + area(b) - common(a, b)
    return common(a, b) / (F.greatest(F.lit(least_union), joint) if least_union else joint)


def contains(outer: Column, inner: Column) -> Column:
    return (inner.x0 >= outer.x0) & (inner.top >= outer.top) & (inner.x1 <= outer.x1) & (inner.bottom <= outer.bottom)


def overlaps(a: Column, b: Column) -> Column:
    """Rows overlap and columns touch, as a link's box overlaps a line."""
    return (a.top < b.bottom) & (a.bottom > b.top) & (a.x0 <= b.x1) & (a.x1 >= b.x0)


def from_bounds(x0: Column, y0: Column, x1: Column, y1: Column, page_width: Column, page_height: Column) -> Column:
    """A box from bounds whose y runs upwards, clipped to the page."""
    zero = F.lit(0.0)
    return box(F.greatest(zero, x0), F.greatest(zero, page_height - y1), F.least(page_width, x1), F.least(page_height, page_height - y0))


def from_thousandths(values: Column, page_width: Column, page_height: Column) -> Column:
    """A box from four numbers of 0 to 1000."""
    return box(*[values[k] / 1000 * (page_height if k % 2 else page_width) for k in range(4)])


def valid_thousandths(values: Column) -> Column:
    """Whether values are four numbers of 0 to 1000 with some extent."""
    inside = F.forall(values, lambda v: v.isNotNull() & v.between(0, 1000))
    return F.coalesce((F.size(values) == 4) & inside & (values[2] > values[0]) & (values[3] > values[1]), F.lit(False))


def role(b: Column, page_width: Column, page_height: Column) -> Column:
    """What a raster image is: the background of a scan if it covers over 85 % of the page."""
    covered = area(b) / (page_width * page_height)
    return F.when(covered > 0.85, F.lit("scan_background")).otherwise(F.lit("illustration"))


def shown_size(b: Column) -> Column:
    """How an illustration is shown: by its width in per cent of 420 points, by height if it is tall."""
    across = F.greatest(F.lit(20), F.least(F.lit(100), F.bround(width(b) / 420 * 100).cast("int")))
    tall = (height(b) > 0) & (across / F.greatest(F.lit(0.01), width(b) / height(b)) > 90)
    return F.when(b.isNull(), F.lit("width: 100%")).when(tall, F.lit("height: 65%")).otherwise(F.concat(F.lit("width: "), across.cast("string"), F.lit("%")))
