"""Silver standard: prose read with the structured answer masked, then compared."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CELL, PROSE, TrialConfig
from ..functions import values
from ..functions.mentions import MentionReader
from ..functions.stats import count_if, f1, ratio, round4

CONFIDENCE = "double"  # as stated; results are rounded, so the order of the sum does not show


def comparisons(linked: DataFrame, documents: DataFrame, config: TrialConfig,
                modifier: str = "mucosal_involvement", profiles: Sequence[str] | None = None
                ) -> DataFrame:
    """One row per record of the studies that hold the modifier both ways.

    The comparator comes from the source row, which is already at hand; the reader
    sees the text alone.
    """
    eligible = [p for p in config.both_routes(modifier) if profiles is None or p in profiles]
    rows = linked.filter(F.col("profile").isin(*eligible))
    in_comment = [p for p in eligible
                  if config.places_of(modifier, PROSE, p)[0].kind == "comment"]
    raw, variable = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pid in eligible:
        home = config.places_of(modifier, CELL, pid)[0]
        cell = (F.try_element_at("findings", F.lit(home.variable)) if home.kind == "linked_form"
                else F.col(home.variable))
        raw = F.when(F.col("profile") == pid, cell).otherwise(raw)
        variable = F.when(F.col("profile") == pid, home.variable).otherwise(variable)
    term = F.coalesce(values.strip(F.col("AETERM")), F.lit(""))
    if in_comment:
        first = documents.groupBy(F.col("source_record_id").alias("AESPID")).agg(
            F.min_by("full_text", "doc_id").alias("first_text"))
        rows = rows.join(first, "AESPID", "left")
        from_comment = F.col("profile").isin(*in_comment)
        text = F.when(from_comment, F.coalesce("first_text", F.lit(""))).otherwise(term)
        kind = F.when(from_comment, "comment").otherwise("reported_term")
    else:
        text, kind = term, F.lit("reported_term")
    staged = rows.select(
        F.col("AESPID").alias("source_record_id"), F.col("STUDYID").alias("study_id"), "profile",
        F.col("style").alias("reported_term_style"), F.lit(modifier).alias("modifier"),
        values.three_state(raw).alias("structured_assertion"),
        variable.alias("structured_variable"), text.alias("text"), kind.alias("kind"),
    ).filter("text <> ''")
    best = MentionReader(config).best("text", modifier, "kind")
    read = staged.select("*", F.explode(F.array(F.expr(best))).alias("said"))
    agreement = (F.when(F.col("said").isNull(), "abstained")
                 .when(F.col("said.assertion").eqNullSafe(F.col("structured_assertion")), "agree")
                 .otherwise("disagree"))
    return read.select(
        "source_record_id", "study_id", "profile", "reported_term_style", "modifier",
        "structured_assertion", "structured_variable",
        F.col("said.assertion").alias("extracted_assertion"),
        F.col("said.value").alias("extracted_value"),
        F.col("said.confidence").alias("extracted_confidence"), "text",
        F.coalesce("said.surface", F.lit("")).alias("span_text"), agreement.alias("agreement"),
        F.coalesce("said.rule", F.lit("abstained")).alias("note"))


def _answered() -> Column:
    return F.col("extracted_assertion").isNotNull()


def metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1, coverage and abstention: overall, per profile, per style."""
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("key")) for s, k in (
        ("overall", F.lit("ALL")), ("profile", F.col("profile")),
        ("reported_term_style", F.col("reported_term_style")))])
    counted = rows.select(F.explode(scopes).alias("s"), "structured_assertion",
                          "extracted_assertion", "agreement").groupBy("s.scope", "s.key").agg(
        F.count(F.lit(1)).alias("eligible_records"),
        F.count("structured_assertion").alias("with_comparator"),
        F.count("extracted_assertion").alias("answered"),
        *[count_if(F.col("agreement") == a).alias(n) for a, n in (
            ("agree", "agreements"), ("disagree", "disagreements"),
            ("abstained", "abstentions"))])
    precision = ratio(F.col("agreements"), F.col("answered"))
    recall = ratio(F.col("agreements"), F.col("with_comparator"))
    return counted.select(
        "*", precision.alias("precision"), recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        ratio(F.col("answered"), F.col("eligible_records")).alias("coverage"),
        ratio(F.col("abstentions"), F.col("eligible_records")).alias("abstention_rate"))


def by_assertion(rows: DataFrame) -> DataFrame:
    """Agreement per class the comparator recorded."""
    counted = rows.filter("structured_assertion is not null").groupBy(
        "structured_assertion").agg(
        F.count(F.lit(1)).alias("n"), F.count("extracted_assertion").alias("answered"),
        count_if(F.col("agreement") == "agree").alias("correct"))
    return counted.select(
        "*", ratio(F.col("correct"), F.col("n")).alias("recall"),
        ratio(F.col("correct"), F.col("answered")).alias("precision"))


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Stated confidence against observed accuracy per bin; the last bin is closed."""
    confidence = F.coalesce("extracted_confidence", F.lit(0.0))
    place = F.when((confidence < 0) | (confidence > 1), None)
    for i in range(bins - 1):
        place = place.when(confidence < (i + 1) / bins, i)
    hit = F.col("agreement") == "agree"
    counted = rows.filter(_answered()).withColumn("bin", place.otherwise(bins - 1)).filter(
        "bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), count_if(hit).alias("correct"),
        F.sum(confidence.cast(CONFIDENCE)).alias("confidence_sum"))
    mean = ratio(F.col("confidence_sum"), F.col("n"))
    observed = ratio(F.col("correct"), F.col("n"))
    return counted.select("bin", "n", "correct", mean.alias("mean_confidence"),
                          observed.alias("observed_accuracy"), (mean - observed).alias("gap"))


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Brier score and expected calibration error."""
    confidence = F.coalesce("extracted_confidence", F.lit(0.0)).cast(CONFIDENCE)
    miss = confidence - F.when(F.col("agreement") == "agree", 1).otherwise(0)
    brier = rows.filter(_answered()).agg(
        F.count(F.lit(1)).alias("answered"), F.sum(miss * miss).alias("squares")).select(
        "answered", round4(ratio(F.col("squares"), F.col("answered"), None)).alias("brier_score"))
    gap = F.abs(round4(F.col("gap"))).cast("decimal(10,4)")
    error = reliability(rows, bins).agg(
        round4(ratio(F.sum(gap * F.col("n")), F.sum("n"), None))
        .alias("expected_calibration_error"))
    # one row beside one row
    return brier.crossJoin(F.broadcast(error))


def adjudication_queue(rows: DataFrame, seed: int = 7, sample: int = 20,
                       below: float = 0.8) -> DataFrame:
    """Disagreements, low-confidence answers and a fixed-size sample of the other agreements.

    The sample is the smallest seeded hashes, a top-n cut inside each task.
    """
    low = _answered() & (F.col("agreement") != "disagree") & (
        F.coalesce("extracted_confidence", F.lit(0.0)) < below)
    reason = (F.when(F.col("agreement") == "disagree", "disagreement")
              .when(low, "low_confidence"))
    marked = rows.withColumn("queue_reason", reason)
    settled = marked.filter("queue_reason is null and agreement = 'agree'")
    sampled = settled.orderBy(F.xxhash64(F.lit(seed), "source_record_id"),
                              "source_record_id").limit(sample).withColumn(
        "queue_reason", F.lit("sampled_agreement"))
    return marked.filter("queue_reason is not null").unionByName(sampled)


def write_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").json(path)
