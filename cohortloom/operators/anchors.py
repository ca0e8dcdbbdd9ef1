"""Exposure anchors and cumulative dose, safe for a subject holding most of the rows.

Everything ordered is first brought down to one row per subject and calendar day
or dealt in sampled ranges, so a window never meets more rows than there are days
or than a range holds, however many exposures one subject has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConfigError, TrialConfig
from ..functions import values
from .ranges import sorted_rows


def dated_exposures(ex: DataFrame, date_field: str = "EXSTDTC") -> DataFrame:
    """Exposures with a readable date, typed."""
    return ex.select(
        F.col("USUBJID").alias("subject_id"), values.exposure_date(F.col(date_field)).alias("day"),
        F.coalesce(F.col("EXSEQ").try_cast("double"), F.lit(0.0)).alias("seq"),
        F.col("EXSEQ").alias("raw_seq"), F.col("EXDOSE").try_cast("double").alias("dose"),
        F.col("EXDOSU").alias("unit"),
    ).filter(F.col("day").isNotNull())


def first_exposure(ex: DataFrame, date_field: str = "EXSTDTC") -> DataFrame:
    """Earliest exposure per subject by (date, sequence); combines on the map side."""
    order = F.struct("day", "seq")
    return dated_exposures(ex, date_field).groupBy("subject_id").agg(
        F.min(order).alias("o"), F.min_by("raw_seq", order).alias("s")
    ).select("subject_id", F.col("o.day").alias("anchor_date"),
             F.concat_ws(":", F.lit("EX"), "subject_id", F.coalesce("s", F.lit("?")))
             .alias("anchor_record"))


def dose_changes(ex: DataFrame, rule: str, date_field: str = "EXSTDTC") -> DataFrame:
    """Exposures whose dose exceeds every earlier one, or falls below the previous one.

    Positions are dealt in sampled ranges of (subject, day, sequence, dose), so one subject's
    exposures, even those of a single day, spread over ranges; each range hands the next
    its running maximum, or its last dose.
    """
    if rule not in ("dose_increase", "dose_decrease"):
        raise ConfigError(f"unknown anchor rule {rule!r}")
    rising = rule == "dose_increase"
    # one row per position: equal rows would have no order between them
    at = dated_exposures(ex, date_field).filter("dose is not null and subject_id is not null").groupBy(
        "subject_id", "day", "seq", "dose").agg(F.min("unit").alias("unit"), F.min("raw_seq").alias("raw_seq"))
    placed = sorted_rows(at, ["subject_id", "day", "seq", "dose"], "dose-positions")
    run = ["subject_id", "part"]
    # a row per subject and range
    across = Window.partitionBy("subject_id").orderBy("part")
    held = F.max("dose") if rising else F.max_by("dose", "place")
    carry = (F.max("held").over(across.rowsBetween(Window.unboundedPreceding, -1)) if rising
             else F.lag("held").over(across))
    carried = placed.groupBy(*run).agg(held.alias("held")).withColumn("carry", carry).drop("held")
    inside = Window.partitionBy(*run).orderBy("place")
    joined = placed.join(carried, run)
    before = (F.greatest("carry", F.max("dose").over(
        inside.rowsBetween(Window.unboundedPreceding, -1))) if rising
        else F.coalesce(F.lag("dose").over(inside), F.col("carry")))
    changed = F.col("dose") > F.col("before") if rising else F.col("dose") < F.col("before")
    return joined.withColumn("before", before).filter(changed).select(
        "subject_id", "day", "seq", "before", "dose", "unit",
        F.concat_ws(":", F.lit("EX"), "subject_id", F.coalesce("raw_seq", F.lit("?")))
        .alias("anchor_record"))


def occurrences(ex: DataFrame, config: TrialConfig, event: str) -> DataFrame:
    """Every occurrence of a declared anchor: subject, day, sequence, source record."""
    spec = config.anchors.get(event)
    if spec is None:
        raise ConfigError(f"unknown anchor {event!r}; known: {sorted(config.anchors)}")
    rule, field = spec.get("rule", "first_record"), spec.get("date_field", "EXSTDTC")
    if rule == "first_record":
        return first_exposure(ex, field).select(
            "subject_id", F.col("anchor_date").alias("day"), F.lit(0.0).alias("seq"),
            "anchor_record")
    return dose_changes(ex, rule, field).select("subject_id", "day", "seq", "anchor_record")


def first_occurrence(ex: DataFrame, config: TrialConfig, event: str) -> DataFrame:
    """The first occurrence per subject, as ``anchor_date`` and ``anchor_record``."""
    order = F.struct("day", "seq")
    return occurrences(ex, config, event).groupBy("subject_id").agg(
        F.min("day").alias("anchor_date"), F.min_by("anchor_record", order).alias("anchor_record"))


def resolve(asked: DataFrame, ex: DataFrame, config: TrialConfig, event: str,
            index_rule: str = "first_occurrence") -> DataFrame:
    """Attach one anchor per row of ``asked`` (subject_id, onset).

    ``most_recent_before_onset`` takes the last occurrence on or before onset, and
    the first one where onset is unknown.
    """
    first = first_occurrence(ex, config, event)
    if index_rule == "first_occurrence":
        return asked.join(first, "subject_id", "left")
    if index_rule != "most_recent_before_onset":
        raise ConfigError(f"unknown index rule {index_rule!r}")
    order = F.struct("day", "seq")
    daily = occurrences(ex, config, event).groupBy("subject_id", "day").agg(
        F.max_by("anchor_record", order).alias("record")).select(
        "subject_id", "day", F.lit(0).alias("turn"), F.struct("day", "record").alias("hit"))
    wanted = _days_asked(asked).select("subject_id", "day", F.lit(1).alias("turn"),
                                       F.lit(None).cast("struct<day:date,record:string>")
                                       .alias("hit"))
    w = Window.partitionBy("subject_id").orderBy("day", "turn").rowsBetween(
        Window.unboundedPreceding, 0)
    latest = daily.unionByName(wanted).withColumn("at", F.last("hit", True).over(w)).filter(
        "turn = 1").select("subject_id", F.col("day").alias("onset"), "at")
    unknown = first.select("subject_id", F.struct(
        F.col("anchor_date").alias("day"), F.col("anchor_record").alias("record")).alias("start"))
    chosen = F.when(F.col("onset").isNull(), F.col("start")).otherwise(F.col("at"))
    return (asked.join(latest, ["subject_id", "onset"], "left").join(unknown, "subject_id", "left")
            .withColumn("chosen", chosen)
            .select(*asked.columns, F.col("chosen.day").alias("anchor_date"),
                    F.col("chosen.record").alias("anchor_record")))


def _days_asked(asked: DataFrame) -> DataFrame:
    return asked.filter("onset is not null").select(
        "subject_id", F.col("onset").alias("day")).distinct()


def dose_before(asked: DataFrame, ex: DataFrame) -> DataFrame:
    """Dose-days taken strictly before each (subject_id, onset); null when none counts.

    A dose running from s to e adds dose*(min(e, onset) - s). Summed over exposures
    that is onset*D - M, where D and M are running sums of dose and dose*day that
    rise at each start and fall at each end. The sums need one row per subject and
    day, so no event is ever paired with an exposure. Decimals keep them exact: doses
    up to 1e17, to ten digits after the point. A larger one stops the job, as leaving it
    out or cutting it would give a wrong sum.
    """
    number, exact = F.col("EXDOSE").try_cast("double"), F.col("EXDOSE").try_cast("decimal(27,10)")
    fits = F.when(number.isNotNull() & exact.isNull(), F.raise_error(F.concat(
        F.lit("dose out of range: "), F.col("EXDOSE")))).otherwise(exact)
    end = F.when(~values.is_blank(F.col("EXENDTC")), values.exposure_date(F.col("EXENDTC")))
    usable = ex.select(
        F.col("USUBJID").alias("subject_id"),
        values.exposure_date(F.col("EXSTDTC")).alias("s"), end.alias("e"),
        fits.cast("decimal(27,10)").alias("dose"),
    ).filter("s is not null and dose is not null and (e is null or e > s)")
    steps = usable.select("subject_id", F.explode(F.array(
        F.struct(F.col("s").alias("day"), F.col("dose").alias("d"), F.lit(1).alias("n")),
        F.struct(F.col("e").alias("day"), (-F.col("dose")).alias("d"), F.lit(0).alias("n")),
    )).alias("x")).select("subject_id", "x.*").filter("day is not null")
    daily = steps.groupBy("subject_id", "day").agg(
        F.sum("d").cast("decimal(27,10)").alias("d"), F.sum("n").alias("n"))
    typed = daily.select("subject_id", "day", F.lit(1).alias("turn"), "d",
                         (F.col("d") * F.unix_date("day")).cast("decimal(38,10)").alias("m"), "n")
    wanted = _days_asked(asked).select(
        "subject_id", "day", F.lit(0).alias("turn"), F.lit(None).cast("decimal(27,10)").alias("d"),
        F.lit(None).cast("decimal(38,10)").alias("m"), F.lit(None).cast("bigint").alias("n"))
    # turn 0 sorts first: an exposure starting on the onset day does not count
    w = Window.partitionBy("subject_id").orderBy("day", "turn").rowsBetween(
        Window.unboundedPreceding, 0)
    total = F.sum("d").over(w).cast("decimal(27,10)") * F.unix_date("day") - F.sum("m").over(w)
    return (typed.unionByName(wanted)
            .select("subject_id", "day", "turn", total.cast("double").alias("total"),
                    F.sum("n").over(w).alias("counted"))
            .filter("turn = 0 and counted > 0")
            .select("subject_id", F.col("day").alias("onset"), F.col("total").alias("dose_days"),
                    F.col("counted").alias("n_exposures")))

