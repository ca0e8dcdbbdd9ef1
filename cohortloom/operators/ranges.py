"""Sorted tables in sampled ranges, and running totals over them.

Rows are dealt by ranges that Spark samples from the order itself, so how keys are spelled
and how common one of them is do not decide which task they go to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def sorted_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The table in the order of ``order``, written once, with ``part`` and ``place``.

    ``part`` grows with the order and ``place`` counts from 0 inside it; no key sits in one
    task as long as ``order`` ends in something that tells rows apart. Writing fixes both
    for every later reader.
    """
    laid = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("row_mark", F.monotonically_increasing_id()))
    kept = written(laid, name)
    return kept.select(*df.columns, F.shiftright("row_mark", 33).alias("part"),
                       F.col("row_mark").bitwiseAND((1 << 33) - 1).alias("place"))


def before(totals: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` over the earlier parts: one row per part (and group), so the window stays small."""
    window = Window.partitionBy(*(by or [])).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))
