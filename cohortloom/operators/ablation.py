"""Value ablation: what each text source adds, in correctly ascertained cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..config import TrialConfig
from ..definitions import Definition
from ..functions.stats import count_if, ratio, round4
from ..sources.snapshot import Snapshot
from . import extract, normalize
from .evaluate import in_concept_set, judge, with_dose

STAGES = [name for name, _ in fixed.ABLATION_STAGES]


def staged_records(snapshot: Snapshot, config: TrialConfig, definition: Definition | None = None) -> DataFrame:
    """Records with a map of modifiers per stage, ``modifiers_<stage>``, and what the texts say.

    One pass: rows are linked and every text is read once, at the widest stage. A
    stage is a column that uses what it may read, so comparing stages is a filter
    over one row rather than a join between runs. With a definition, its records alone.
    """
    configs = {name: config.reading(sources) for name, sources in fixed.ABLATION_STAGES}
    widest = configs[STAGES[-1]]
    recs = normalize.records(normalize.link(snapshot, widest, normalize.ANSWERS), widest)
    if definition:
        recs = with_dose(in_concept_set(recs, definition, config), definition, snapshot.ex)
    read = extract.read_prose(recs, widest)
    return read.withColumns({f"modifiers_{name}": (
        extract.filled_modifiers(c, True) if c.readable_sources else F.col("modifiers"))
        for name, c in configs.items()})


def stage_maps() -> dict[str, str]:
    """The map of modifiers that decides each stage."""
    return {name: f"modifiers_{name}" for name in STAGES}


def staged_verdicts(snapshot: Snapshot, config: TrialConfig, definition: Definition) -> DataFrame:
    """One row per in-scope record with its verdict and answer at every stage."""
    staged = staged_records(snapshot, config, definition)
    return with_answers(judge(staged, definition, stage_maps(), "record_id", "source_record_id", "study_id"), snapshot)


def with_answers(verdicts: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The answer at every stage beside the verdict."""
    gold = snapshot.gold().select("source_record_id", *[
        F.col(f"verdict_stage_{s}").alias(f"gold_{s}") for s in STAGES])
    return verdicts.select("record_id", "source_record_id", "study_id", *STAGES).join(
        gold, "source_record_id", "left")


def _case(stage: str) -> Column:
    return F.col(stage) == "case"


def _settled(stage: str) -> Column:
    return F.col(stage).isin("case", "non_case")


def _right(stage: str) -> Column:
    return F.coalesce(F.col(f"gold_{stage}") == "case", F.lit(False))


def stage_metrics(verdicts: DataFrame) -> DataFrame:
    """Ascertained, cases, correct and wrong cases, precision and recall per stage."""
    rows = verdicts.select(F.explode(F.array(*[F.struct(
        F.lit(i + 1).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("verdict"),
        F.col(f"gold_{s}").alias("gold")) for i, s in enumerate(STAGES)])).alias("x"))
    case, gold = F.col("x.verdict") == "case", F.col("x.gold")
    counted = rows.groupBy("x.position", "x.stage").agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        count_if(F.col("x.verdict").isin("case", "non_case")).alias("n_ascertained"),
        count_if(case).alias("n_case"), count_if(case & (gold == "case")).alias("n_case_correct"),
        count_if(case & (gold != "case")).alias("n_case_incorrect"),
        count_if(gold == "case").alias("gold_cases"))
    return counted.select(
        "*", ratio(F.col("n_ascertained"), F.col("n_evaluated")).alias("ascertainable_fraction"),
        ratio(F.col("n_case_correct"), F.col("n_case")).alias("precision"),
        ratio(F.col("n_case_correct"), F.col("gold_cases")).alias("recall"))


def increments(verdicts: DataFrame) -> DataFrame:
    """What each stage adds over the one below, judged against the declared floors."""
    pairs = list(zip(STAGES, STAGES[1:]))
    rows = verdicts.select(F.explode(F.array(*[F.struct(
        F.lit(i + 1).alias("position"), F.lit(low).alias("from_stage"),
        F.lit(up).alias("to_stage"), (_case(up) & ~_case(low)).alias("added"),
        (_case(up) & ~_case(low) & _right(up)).alias("added_right"),
        (_case(low) & _right(low)).alias("base_right"),
        (_settled(up) & ~_settled(low)).alias("newly_settled"))
        for i, (low, up) in enumerate(pairs)])).alias("x"))
    counted = rows.groupBy("x.position", "x.from_stage", "x.to_stage").agg(
        count_if(F.col("x.added")).alias("added_cases"),
        count_if(F.col("x.added_right")).alias("added_correct"),
        count_if(F.col("x.base_right")).alias("base_correct"),
        count_if(F.col("x.newly_settled")).alias("added_ascertained"))
    floors = fixed.ADOPTION_FLOORS
    added, right = F.col("added_cases"), F.col("added_correct")
    # with no correct case below, any correct addition is an unbounded gain
    gain = F.coalesce(round4(ratio(right, F.col("base_correct"), None)),
                      F.when(right > 0, F.lit(float("inf"))).otherwise(0.0))
    clean = (added > 0) & (F.col("precision_on_added") >= floors["precision_on_added"])
    material = (clean & (right >= floors["added_correct"])
                & (F.col("relative_gain") >= floors["relative_gain"]))
    decision = (F.when(material, "ADOPT").when(added == 0, "DO NOT ADOPT: no verdict changed")
                .when(~clean, "DO NOT ADOPT AS IT STANDS: too many additions are wrong")
                .otherwise("DO NOT ADOPT: gain below the declared floor"))
    return counted.withColumns({
        "added_incorrect": added - right,
        "precision_on_added": round4(ratio(right, added)), "relative_gain": gain,
    }).withColumn("material", material).withColumn("decision", decision)


def headline(steps: DataFrame) -> DataFrame:
    """The decision on the first increment."""
    return steps.filter("position = 1").select("from_stage", "to_stage", "decision")
