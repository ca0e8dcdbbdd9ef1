"""Episodes: records of one subject, study and concept within a gap tolerance.

A group may hold any share of the records. Records are sorted by (group, onset, id) in
sampled ranges; windows run over a group's rows inside a range and over one summary row per
group and range. Members stay one row each and are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import before, sorted_rows

GROUP = ["study_id", "subject_id", "concept"]
RUN = [*GROUP, "part"]


def members(recs: DataFrame, tolerance: int = 3) -> DataFrame:
    """One row per record with its place: group, episode number in the group, joining gap.

    A record joins its predecessor when onset follows the predecessor's end (or
    onset) by at most ``tolerance`` days. Records without an onset stand alone.
    """
    base = written(recs.select(
        "record_id", "study_id", "subject_id",
        F.coalesce("concept_id", F.lit("UNCODED")).alias("concept"),
        F.col("onset.value").alias("onset_day"),
        F.coalesce("end.value", "onset.value").alias("closes")), "episode-records")
    dated = sorted_rows(base.filter("onset_day is not null"), [*GROUP, "onset_day", "record_id"],
                        "episode-dated")
    undated = sorted_rows(base.filter("onset_day is null"), [*GROUP, "record_id"], "episode-undated")

    inside = Window.partitionBy(*RUN).orderBy("place")
    across = Window.partitionBy(*GROUP).orderBy("part")
    # each range hands its last closing day to the next one of the group
    ends = dated.groupBy(*RUN).agg(F.max_by("closes", "place").alias("held"))
    carried = ends.withColumn("carry", F.lag("held").over(across)).drop("held")
    gap = F.datediff("onset_day", F.coalesce(F.lag("closes").over(inside), F.col("carry")))
    joined = dated.join(carried, RUN).withColumn("gap", gap)
    flagged = joined.withColumn("opens", F.when(F.col("gap") <= tolerance, 0).otherwise(1))
    # episode number in the group = openings in earlier ranges + openings so far here
    openings = before(flagged.groupBy(*RUN).agg(F.sum("opens").alias("n")), "n", "before", GROUP).drop("n")
    placed = flagged.join(openings, RUN).withColumn(
        "ordinal", F.col("before") + F.sum("opens").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
    kept = placed.select(*GROUP, "record_id", "onset_day", "ordinal",
                         F.when(F.col("opens") == 0, F.col("gap")).alias("gap"),
                         F.lit(False).alias("apart"))
    return written(kept.unionByName(_undated(undated, placed)), "episode-members")


def _undated(undated: DataFrame, placed: DataFrame) -> DataFrame:
    """Records without onset follow the dated ones, each its own episode."""
    dated = placed.groupBy(*GROUP).agg(F.max("ordinal").alias("dated"))
    sizes = before(undated.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")),
                   "n", "before", GROUP).drop("n")
    numbered = undated.join(sizes, RUN).join(dated, GROUP, "left").withColumn(
        "nth", F.col("before") + F.col("place") - F.col("first") + 1)
    dated_so_far = F.coalesce("dated", F.lit(0))
    return numbered.select(
        *GROUP, "record_id", "onset_day", (dated_so_far + F.col("nth")).alias("ordinal"),
        F.lit(None).cast("int").alias("gap"),
        (dated_so_far + F.col("nth") > 1).alias("apart"))


def episodes(placed: DataFrame, tolerance: int = 3) -> DataFrame:
    """One row per episode. Rule, review flag and gap come from the last merged record."""
    last = F.struct(F.coalesce("onset_day", F.lit("9999-12-31").cast("date")), "record_id")
    grouped = placed.groupBy(*GROUP, "ordinal").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("onset_day").alias("first_onset"),
        F.max("onset_day").alias("last_onset"), F.max_by("gap", last).alias("last_gap"),
        F.min("record_id").alias("min_record_id"), F.max("record_id").alias("max_record_id"),
        F.max("apart").alias("apart"))
    merged = F.col("n_records") > 1
    note = (F.when(merged, F.format_string(
        f"last two records %d day(s) apart, tolerance {tolerance}", F.col("last_gap")))
        .when(F.col("apart"), "kept apart: no readable onset").otherwise(""))
    return grouped.select(
        *GROUP, "ordinal", "n_records", "first_onset", "last_onset", "min_record_id",
        "max_record_id",
        F.when(merged, "gap_within_tolerance").otherwise("single_record").alias("rule"),
        F.when(merged, 0.7).otherwise(1.0).alias("confidence"),
        (merged & (F.coalesce("last_gap", F.lit(0)) > 0)).alias("review_required"),
        note.alias("note"))


def number(grouped: DataFrame) -> DataFrame:
    """Add the global episode number and id: groups counted in sorted ranges, ranges summed up."""
    sized = sorted_rows(grouped.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")), GROUP, "episode-groups")
    earlier = before(sized.groupBy("part").agg(F.sum("n").alias("total")), "total", "part_base") \
        .select("part", "part_base")  # a row per range
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.join(earlier, "part").select(
        *GROUP, (F.col("part_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    serial = F.col("base") + F.col("ordinal")
    text = serial.cast("string")
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return grouped.join(base, GROUP).withColumn("episode_number", serial).withColumn(
        "episode_id", F.concat_ws("::", *GROUP, padded)).drop("base")


def record_episodes(placed: DataFrame, numbered: DataFrame) -> DataFrame:
    """The episode each record belongs to."""
    return placed.select(*GROUP, "ordinal", "record_id").join(
        numbered.select(*GROUP, "ordinal", "episode_id", "rule"), [*GROUP, "ordinal"]).select(
        "record_id", "episode_id", "rule")


def rule_counts(grouped: DataFrame) -> DataFrame:
    """Episodes, records and flags per rule."""
    return grouped.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum("n_records").alias("n_records"),
        F.count_if("review_required").alias("n_flagged"))
