"""Nearest values before and after, without a task that sees all rows.

Positions are dealt into stretches of equal length. Each stretch is looked at by
itself, and what it lacks comes from the stretches around, of which there is a
row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1000


def nearest(rows: DataFrame, order: str, value: str, name: str, after: bool = False, itself: bool = False, stretch: int = STRETCH) -> DataFrame:
    """rows (one for each whole number in order) with name: the last value before that is not null, or the first after.

    itself: a row's own value counts as well.
    """
    at = F.floor(F.col(order) / stretch)
    own = rows.withColumn("_at", at)
    towards: Column = F.col(order).desc() if after else F.col(order).asc()
    inside = Window.partitionBy("_at").orderBy(towards).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    ends = own.where(F.col(value).isNotNull()).groupBy("_at").agg((F.min_by if after else F.max_by)(value, order).alias("_end"))
    stretches = own.select("_at").distinct().join(ends, "_at", "left")
    along = F.col("_at").desc() if after else F.col("_at").asc()
    carried = stretches.select("_at", F.last("_end", ignorenulls=True).over(Window.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = own.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).join(carried, "_at")
    return found.withColumn(name, F.coalesce("_inside", "_carried")).drop("_at", "_inside", "_carried")
