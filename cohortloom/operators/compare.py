"""Two definitions, compared by what they claim on the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ConfigError


def require_scope(scope: str | None) -> str:
    """A comparison must name the question it serves."""
    if not scope or not scope.strip():
        raise ConfigError("a comparison needs a scope: a question or a phenotype family")
    return scope.strip()


def side_by_side(a: DataFrame, b: DataFrame, scope: str | None) -> DataFrame:
    """One row per record either run judged: both verdicts and how the case moved.

    For stored assignments. Definitions over the same records need no join: see
    ``evaluate.judge_both``.
    """
    require_scope(scope)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("record_id", *[F.col(c).alias(f"{c}_{s}") for c in (
            "subject_id", "study_id", "verdict", "deciding_criterion", "reason")])
    both = side(a, "a").join(side(b, "b"), "record_id", "full")
    return case_changes(both.select(
        "record_id", F.coalesce("subject_id_a", "subject_id_b").alias("subject_id"),
        F.coalesce("study_id_a", "study_id_b").alias("study_id"), "verdict_a", "verdict_b",
        F.col("deciding_criterion_a").alias("deciding_a"),
        F.col("deciding_criterion_b").alias("deciding_b"), "reason_a", "reason_b"))


def case_changes(pairs: DataFrame) -> DataFrame:
    """Add whether a case is shared, gained or lost."""
    was = F.coalesce(F.col("verdict_a") == "case", F.lit(False))
    now = F.coalesce(F.col("verdict_b") == "case", F.lit(False))
    return pairs.withColumn("case_change", F.when(was & now, "shared").when(now, "gained")
                            .when(was, "lost"))


def discordant(pairs: DataFrame) -> DataFrame:
    """Records both judged, differently."""
    return pairs.filter("verdict_a <> verdict_b").drop("case_change")


def case_sets(pairs: DataFrame) -> DataFrame:
    """Shared, gained and lost cases, one row each."""
    return pairs.filter("case_change is not null").select("record_id", "study_id", "case_change")


def summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        *[F.count_if(F.coalesce(F.col("case_change") == c, F.lit(False))).alias(c)
          for c in ("shared", "gained", "lost")],
        F.count_if(F.coalesce(F.col("verdict_a") != F.col("verdict_b"), F.lit(False)))
        .alias("discordant"))
