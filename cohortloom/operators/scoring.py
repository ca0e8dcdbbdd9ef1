"""Scoring against answer keys: case metrics, confusion, invariance, study holdout, ranking.

Every score starts from cell counts of a confusion matrix, one grouped pass
whatever the number of scopes; ratios are taken on those few cells.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..config import ConfigError, TrialConfig
from ..functions.stats import count_if, f1, ratio


def with_gold(rows: DataFrame, gold: DataFrame, *columns: str) -> DataFrame:
    """Join answer-key columns by source record."""
    return rows.join(gold.select("source_record_id", *columns), "source_record_id")


def scoped_cells(rows: DataFrame, gold: str, predicted: str, scopes: dict[str, Column]
                 ) -> DataFrame:
    """Confusion cells for several scopes at once: (scope, key, gold, predicted, n)."""
    entries = F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("key"))
                        for s, k in scopes.items()])
    return rows.select(F.explode(entries).alias("s"), F.col(gold).alias("gold"),
                       F.col(predicted).alias("predicted")).groupBy(
        "s.scope", "s.key", "gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _cells(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def case_metrics(cells: DataFrame, *by: str) -> DataFrame:
    """PPV, sensitivity and F1 for cases, with what could not be ascertained beside them."""
    g, p = F.col("gold"), F.col("predicted")
    na = "not_ascertainable"
    counted = cells.groupBy(*by).agg(
        F.sum("n").alias("records"), _cells((g == "case") & (p == "case")).alias("tp"),
        _cells((g != "case") & (p == "case")).alias("fp"),
        _cells((g == "case") & (p != "case")).alias("fn"), _cells(g == p).alias("correct"),
        _cells(p == na).alias("na_predicted"), _cells(g == na).alias("na_gold"),
        _cells((g == na) & (p == na)).alias("na_both"))
    ppv = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    sensitivity = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select(
        *by, "records", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("gold_cases"),
        (F.col("tp") + F.col("fp")).alias("predicted_cases"), ppv.alias("ppv"),
        sensitivity.alias("sensitivity"), f1(ppv, sensitivity).alias("f1"),
        ratio(F.col("correct"), F.col("records")).alias("accuracy"),
        F.col("na_predicted").alias("not_ascertainable_predicted"),
        F.col("na_gold").alias("not_ascertainable_gold"),
        ratio(F.col("na_predicted"), F.col("records")).alias("not_ascertainable_rate"),
        ratio(F.col("na_both"), F.col("na_gold")).alias("not_ascertainable_agreement"))


def phenotype_cells(assignments: DataFrame, gold: DataFrame) -> DataFrame:
    """Verdict confusion, pooled and per study and profile."""
    return scoped_cells(with_gold(assignments, gold, "true_verdict"), "true_verdict", "verdict", {
        "pooled": F.lit("ALL"), "study": F.col("study_id"), "profile": F.col("profile")})


# -- silence against documented negatives -------------------------------------------

def assertion_rows(recs: DataFrame, gold: DataFrame, modifier: str) -> DataFrame:
    """Expected and actual assertion and availability per record."""
    a = F.col("modifiers")[modifier]
    flat = recs.select("record_id", "study_id", "subject_id", "source_record_id", "profile",
                       a["availability"].alias("seen"), F.coalesce(
                           a["assertion"], F.lit("silent")).alias("actual"),
                       F.coalesce(a["note"], F.lit("")).alias("note"))
    keyed = with_gold(flat, gold, "structured_assertion", "text_assertion", "true_availability")
    return keyed.select(
        "record_id", "study_id", "subject_id", "source_record_id", "profile", "actual", "note",
        F.coalesce("structured_assertion", "text_assertion", F.lit("silent")).alias("expected"),
        F.coalesce("true_availability", F.lit("unresolved")).alias("expected_availability"),
        F.coalesce("seen", F.lit("unresolved")).alias("actual_availability"))


def assertion_cells(rows: DataFrame) -> DataFrame:
    """Assertion and availability confusion cells in one pass."""
    pairs = F.array(
        F.struct(F.lit("assertion").alias("matrix"), F.col("expected").alias("gold"),
                 F.col("actual").alias("predicted")),
        F.struct(F.lit("availability").alias("matrix"),
                 F.col("expected_availability").alias("gold"),
                 F.col("actual_availability").alias("predicted")))
    return rows.select(F.explode(pairs).alias("p")).groupBy(
        "p.matrix", "p.gold", "p.predicted").agg(F.count(F.lit(1)).alias("n"))


def assertion_summary(cells: DataFrame) -> DataFrame:
    """Accuracy, negatives lost and silence read as an answer."""
    g, p = F.col("gold"), F.col("predicted")
    counted = cells.filter("matrix = 'assertion'").agg(
        F.sum("n").alias("records"), _cells(g == p).alias("correct"),
        _cells((g == "absent") & (p != "absent")).alias("negatives_lost"),
        _cells((g == "silent") & (p != "silent")).alias("silence_invented"),
        _cells((g == "absent") & (p == "absent")).alias("negatives_recovered"))
    return counted.withColumn("accuracy", ratio(F.col("correct"), F.col("records")))


def assertion_examples(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The disagreements, all of them or the first ``limit`` in stable record order."""
    found = rows.filter("expected <> actual")
    if limit:
        found = found.orderBy("study_id", "subject_id", "source_record_id").limit(limit)
    return found.select("source_record_id", "profile", "expected", "actual", "note")


# -- one truth, several renderings -----------------------------------------------------

def renderings(assignments: DataFrame, gold: DataFrame) -> DataFrame:
    """One verdict per shared truth and profile: the last record in stable order."""
    keyed = with_gold(assignments.select("source_record_id", "subject_id", "profile", "verdict",
                                         "reason"), gold, "truth_id", "cohort", "readable",
                      "verdict_if_readable").filter("cohort = 'shared'")
    last = F.struct("subject_id", "source_record_id")
    return keyed.groupBy("truth_id", "profile").agg(
        F.max_by(F.struct("verdict", "readable", "reason",
                          F.col("verdict_if_readable").alias("reference")), last).alias("r")
    ).select("truth_id", "profile", "r.*")


def truth_agreement(rendered: DataFrame) -> DataFrame:
    """Per truth with two or more renderings: do verdicts agree, overall and where readable."""
    return rendered.groupBy("truth_id").agg(
        F.count(F.lit(1)).alias("n_profiles"),
        (F.min("verdict") == F.max("verdict")).alias("agrees"),
        count_if(F.col("readable")).alias("n_readable"),
        (F.min(F.when(F.col("readable"), F.col("verdict")))
         == F.max(F.when(F.col("readable"), F.col("verdict")))).alias("readable_agrees"),
        F.min_by("reference", "profile").alias("reference"),
        F.min_by(F.when(F.col("readable"), F.col("reason")),
                 F.when(F.col("readable"), F.col("profile"))).alias("example_reason"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "profile", "verdict"))), ";")
        .alias("verdicts"),
    ).filter("n_profiles >= 2")


def invariance(agreement: DataFrame) -> DataFrame:
    supported = F.col("n_readable") > 0
    counted = agreement.agg(
        F.count(F.lit(1)).alias("truths_compared"), count_if(F.col("agrees")).alias("agreeing"),
        count_if(supported).alias("truths_with_evidence"),
        count_if(supported & F.col("readable_agrees")).alias("agreeing_with_evidence"))
    return counted.select(
        "*", (F.col("truths_with_evidence") - F.col("agreeing_with_evidence")).alias("discordant"),
        ratio(F.col("agreeing"), F.col("truths_compared")).alias("raw_agreement"),
        ratio(F.col("agreeing_with_evidence"), F.col("truths_with_evidence"))
        .alias("supported_agreement"))


def discordant(agreement: DataFrame, limit: int | None = None) -> DataFrame:
    """Truths whose readable renderings disagree, all or the first ``limit`` by id."""
    found = agreement.filter("n_readable > 0 and not readable_agrees")
    if limit:
        found = found.orderBy("truth_id").limit(limit)
    return found.select("truth_id", "reference", "verdicts", "example_reason")


# -- whole-study holdout -----------------------------------------------------------------

def holdout_split(config: TrialConfig, holdout: Sequence[str] | None = None) -> set[str]:
    """Held-out profiles; unknown names and one-sided splits are refused."""
    known = set(config.profiles)
    held = set(holdout) if holdout else known - set(fixed.DEVELOPMENT_PROFILES)
    if held - known:
        raise ConfigError(f"cannot hold out {sorted(held - known)}; known: {sorted(known)}")
    if not held or held == known:
        raise ConfigError("a holdout needs profiles on both sides")
    return held


def holdout_cells(assignments: DataFrame, gold: DataFrame, held: set[str]) -> DataFrame:
    """Verdict confusion by side and by profile."""
    side = F.when(F.col("profile").isin(*sorted(held)), "held_out").otherwise("development")
    return scoped_cells(with_gold(assignments, gold, "true_verdict"), "true_verdict", "verdict",
                        {"side": side, "profile": F.col("profile")})


def holdout_drop(metrics: DataFrame) -> DataFrame:
    """What changes from the development studies to the held-out ones."""
    def on(side: str, column: str) -> Column:
        return F.max(F.when(F.col("key") == side, F.col(column)))
    return metrics.filter("scope = 'side'").agg(
        (on("development", "sensitivity") - on("held_out", "sensitivity"))
        .alias("sensitivity_drop"),
        (on("development", "ppv") - on("held_out", "ppv")).alias("ppv_drop"),
        (on("held_out", "not_ascertainable_rate") - on("development", "not_ascertainable_rate"))
        .alias("not_ascertainable_rate_change"))


# -- ranking -------------------------------------------------------------------------------

#: Parts into which the rows of one query are dealt by item.
SLOTS = 128


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank, recall@k with its ceiling and precision@k per query.

    ``ranked`` has query_id, item_id, score; ``relevant`` has query_id, item_id. The
    top k are cut inside each task before the shuffle, and the first hit's rank is a
    count of better rows, dealt by query and item, so no query is ever ranked in one task.
    """
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    wanted = relevant.distinct().withColumn("hit", F.lit(1))
    cut = ranked.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    at_k = cut.join(wanted, ["query_id", "item_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"), F.count("hit").alias("hits"),
        F.count_distinct(F.when(F.col("hit") == 1, F.col("item_id"))).alias("found"))
    best = ranked.join(wanted, ["query_id", "item_id"]).groupBy("query_id").agg(
        F.max("score").alias("best"),
        F.min_by("item_id", F.struct((-F.col("score")).alias("s"), "item_id")).alias("best_item"))
    ahead = (F.col("score") > F.col("best")) | (
        (F.col("score") == F.col("best")) & (F.col("item_id") < F.col("best_item")))
    # the best hit of a query goes to each of its slots: a query with most rows meets it in many tasks
    slots = best.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)).cast("array<bigint>")))
    dealt = ranked.select("query_id", "item_id", "score", F.pmod(F.xxhash64("item_id"), F.lit(SLOTS)).alias("slot"))
    rank = dealt.join(slots, ["query_id", "slot"]).groupBy("query_id").agg(
        (count_if(ahead) + 1).alias("first_hit"))
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    queries = ranked.select("query_id").distinct()
    joined = queries.join(at_k, "query_id", "left").join(rank, "query_id", "left").join(
        size, "query_id", "left").fillna(0, ["returned", "hits", "found", "relevant"])
    return joined.select(
        "query_id", "relevant", "returned", "hits",
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
        ratio(F.col("found"), F.col("relevant")).alias("recall_at_k"),
        ratio(F.least(F.lit(k), "relevant"), F.col("relevant")).alias("recall_ceiling"),
        ratio(F.col("hits"), F.col("returned")).alias("precision_at_k"))
