"""Connected components of a link table, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node hands the smallest id it knows to its neighbours.

    ``large``: to the neighbours with larger ids; else to those with smaller ids and itself.
    The minimum is aggregated before the join, so a node with very many neighbours is one row
    on that side and the other side's rows may be split over tasks.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        met = down.join(low, "a")
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links to (id, component): the least id reachable, for every id that has a link.

    Each round is written to the shared folder, which cuts the lineage. Rounds grow with the
    logarithm of the longest chain. Links of a node to itself and repeated links are ignored.
    """
    held = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                 F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        held = written(_star(_star(held, True), False), name)
        # the links are stars once neither contraction changes them
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return held.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        held.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
