"""Running totals over all rows in the order of a key, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import range_ids

RANGE_ROWS = 20_000


def running_total(df: DataFrame, key: str, value: str | Column, name: str, ties: list[str], group: str | None = None, range_name: str = "_range", rows: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before it, ascending key (nulls first), then ties.

    group: sums run within each of its values. The rows are dealt into ranges of
    about RANGE_ROWS rows by key; the ranges' sums, a few numbers for each, are
    summed up first, and each range by itself then.
    """
    rows = df.count() if rows is None else rows
    df = range_ids(df, key, max(1, rows // RANGE_ROWS), range_name)
    value = F.col(value) if isinstance(value, str) else value
    by = [group] if group else []
    sums = df.groupBy(range_name, *by).agg(F.sum(value).alias("_sum"))
    # a row for each range and group
    before = sums.select(range_name, *by, (F.sum("_sum").over(Window.partitionBy(*by).orderBy(range_name)) - F.col("_sum")).alias("_before"))
    own = Window.partitionBy(range_name, *by).orderBy(F.col(key).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(own), F.lit(0)).cast("long"))
    return inside.join(before, [range_name, *by]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")
