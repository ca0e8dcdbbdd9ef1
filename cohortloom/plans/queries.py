"""The registered queries: one flat result per operator family, over whole tables.

Structs, maps and arrays are flattened to columns or joined text, counts are
bigint and ratios double, so a plain SQL engine can restate every result.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import attrs, stats, text, values
from ..functions.mentions import MentionReader
from ..operators import (ablation, aggregates, anchors, compare, episodes, evaluate, extract,
                         normalize, retrieval, runs, scoring, silver, text_search, trace)
from ..sources.scratch import once, written
from ..sources.snapshot import with_numbers
from . import order_trial
from .trial import Trial

MUCOSAL = "mucosal_involvement"
V1, V2, TOXICITY = "cutaneous_mucosal.v1", "cutaneous_mucosal.v2", "graded_toxicity.v1"
SCOPE = "mucosal involvement in cutaneous events"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


#: The tables that the mapping of orders to trials reads.
INPUTS = ("orders", "lineitem", "customer", "nation")


#: Bytes of a method that the JVM still compiles; it interprets longer ones for every row.
COMPILED = "8000"


def compiled(spark: SparkSession) -> None:
    """Let Spark run a step operator by operator where one method for all of them would be too long to compile."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)


def trial(spark: SparkSession, sf_dir: str) -> Trial:
    """The trial behind a directory: its plans are built once a session, its event keys written once."""
    compiled(spark)

    def make() -> Trial:
        return Trial(order_trial.snapshot(spark, sf_dir, written(order_trial.base(spark, sf_dir), "event-keys")))
    return once(spark, "trial", [f"{sf_dir}/{name}.parquet" for name in INPUTS], make)


def query(fn: Callable[[Trial], DataFrame]) -> Callable[[Trial], DataFrame]:
    """A query that needs several tables of the trial."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(trial(spark, sf_dir))
    return fn


def scan_query(fn: Callable[[Trial], DataFrame]) -> Callable[[Trial], DataFrame]:
    """A query that reads one table of the trial once: nothing is written for it."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        compiled(spark)
        paths = [f"{sf_dir}/{name}.parquet" for name in INPUTS]
        return fn(once(spark, "scanned", paths, lambda: Trial(order_trial.snapshot(spark, sf_dir))))
    QUERIES[fn.__name__] = run
    return fn


def table_query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def whole(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def text_date(column: str, name: str | None = None) -> Column:
    return F.col(column).cast("string").alias(name or column)


def n_rows(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# -- sources ------------------------------------------------------------------------

@scan_query
def domain_table_scan(t: Trial) -> DataFrame:
    """Event cells with numeric readings beside them, per study."""
    return with_numbers(t.snapshot.ae).groupBy(F.col("STUDYID").alias("study_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("AEGRADE_N").alias("n_grades"),
        F.sum("AEGRADE_N").cast("bigint").alias("grade_sum"),
        F.count_if(F.col("AESEV").isNull()).alias("n_blank_severity"))


@query
def document_full_text(t: Trial) -> DataFrame:
    return t.snapshot.documents.select(
        "doc_id", "source_record_id", "kind", F.length("full_text").alias("n_chars"),
        F.md5("full_text").alias("digest"))


@scan_query
def answer_key_counts(t: Trial) -> DataFrame:
    return n_rows(t.snapshot.gold(), "study_id", "true_availability", "true_verdict")


@scan_query
def truth_renderings(t: Trial) -> DataFrame:
    return t.snapshot.truths().select("truth_id", "concept", "onset_offset_days", "n_renderings",
                                      "rendered_in")


@query
def snapshot_fingerprint(t: Trial) -> DataFrame:
    """Content fingerprints of all six inputs."""
    return t.snapshot.fingerprints()


@query
def subject_cohort(t: Trial) -> DataFrame:
    return t.snapshot.cohort()


@query
def linked_row_counts(t: Trial) -> DataFrame:
    return t.snapshot.linked_counts()


@scan_query
def exposures_by_subject(t: Trial) -> DataFrame:
    return t.snapshot.exposures_by_subject().select("subject_id", "n_exposures",
                                                    whole("first_seq"), whole("last_seq"))


@query
def snapshot_summary(t: Trial) -> DataFrame:
    return t.snapshot.summary()


@query
def corpus_summary(t: Trial) -> DataFrame:
    return t.summary().select("studies", "subjects", "ae_records", "documents",
                              "dictionary_target", "backend")


# -- normalization --------------------------------------------------------------------

@query
def concept_lookup(t: Trial) -> DataFrame:
    coded = F.col("coded_event")
    return n_rows(t.structured.select(
        coded["code"].alias("code"), coded["dictionary_version"].alias("version"),
        "concept_id"), "code", "version", "concept_id")


@query
def code_reconciliation(t: Trial) -> DataFrame:
    coded = F.col("coded_event")
    return n_rows(t.structured.select(
        "study_id", coded["code"].alias("code"), coded["reconciliation"].alias("outcome"),
        normalize.effective_code(coded).alias("effective_code")),
        "study_id", "code", "outcome", "effective_code")


@query
def codelist_readings(t: Trial) -> DataFrame:
    return n_rows(t.structured.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("codelist"), F.col(c)["value"].alias("value"),
        F.col(c)["availability"].alias("availability")) for c in fixed.CODELISTS])).alias("x"))
        .select("x.*"), "codelist", "value", "availability")


@scan_query
def three_state_readings(t: Trial) -> DataFrame:
    """The structured qualifier cell and the seriousness answer, as read."""
    cell = F.col("AEMUCOS")
    return n_rows(t.snapshot.ae.select(
        F.col("STUDYID").alias("study_id"), values.is_blank(cell).alias("blank"),
        values.three_state(cell).alias("assertion"),
        values.yes_no(F.col("AESER")).alias("serious")),
        "study_id", "blank", "assertion", "serious")


@query
def grade_readings(t: Trial) -> DataFrame:
    return t.structured.select("record_id", F.col("grade.value").alias("grade"))


@query
def record_dates(t: Trial) -> DataFrame:
    return t.structured.select(
        "record_id", text_date("onset.value", "onset"), text_date("end.value", "end_day"),
        F.col("onset.availability").alias("onset_availability"),
        (F.col("onset.note") != "").alias("onset_noted"))


@scan_query
def exposure_dates(t: Trial) -> DataFrame:
    return t.snapshot.ex.select(
        F.col("USUBJID").alias("subject_id"), F.col("EXSEQ").alias("seq"),
        values.exposure_date(F.col("EXSTDTC")).cast("string").alias("start_day"),
        values.exposure_date(F.col("EXENDTC")).cast("string").alias("end_day"))


@query
def seriousness_criteria(t: Trial) -> DataFrame:
    return n_rows(t.structured.select("study_id", F.explode("seriousness_criteria").alias(
        "criterion", "a")).select("study_id", "criterion", "a.availability", "a.assertion"),
        "study_id", "criterion", "availability", "assertion")


@query
def structured_modifiers(t: Trial) -> DataFrame:
    a = F.col("modifiers")[MUCOSAL]
    return t.structured.select("record_id", *[a[f].alias(f) for f in (
        "assertion", "availability", "source", "source_variable", "method")])


@query
def exposure_offsets(t: Trial) -> DataFrame:
    a = F.col("exposure_relation")
    return t.structured.select("record_id", a["value"].alias("offset_days"),
                               a["availability"].alias("availability"))


@query
def canonical_records(t: Trial) -> DataFrame:
    return t.structured.select(
        "record_id", "study_id", "subject_id", "profile", "concept_id",
        F.col("reported_term.value").alias("reported_term"),
        F.col("severity.value").alias("severity"), F.col("grade.value").alias("grade"),
        F.col("seriousness.value").alias("serious"), F.col("action.value").alias("action"),
        F.col("outcome.value").alias("outcome"),
        F.array_join("linked_form_ids", ",").alias("linked_forms"))


@scan_query
def undeclared_studies(t: Trial) -> DataFrame:
    """Event rows of studies that a configuration of the development studies alone does not declare."""
    return normalize.undeclared_studies(t.snapshot.ae, t.config.declaring(fixed.DEVELOPMENT_PROFILES))


@query
def provenance_audit(t: Trial) -> DataFrame:
    """Attributes checked and invariants broken; the second must be zero."""
    attributes = t.attribute_fields(*attrs.CHECKED)
    row = F.struct(*[F.col(c) for c in attributes.columns])
    return attributes.select(attrs.n_violations(row).alias("broken")).agg(
        F.count(F.lit(1)).alias("n_attributes"), F.sum("broken").alias("n_broken"))


@query
def provenance_faults(t: Trial) -> DataFrame:
    """The invariants that a damaged attribute table breaks: grades called derived, onsets without evidence."""
    damaged = t.attribute_fields(*attrs.CHECKED).withColumns({
        "method": F.when(F.col("name") == "grade", "derived").otherwise(F.col("method")),
        "evidence": F.when(F.col("name") == "onset", F.slice("evidence", 1, 0)).otherwise(F.col("evidence"))})
    return n_rows(attrs.broken(damaged), "name", "rule")


@query
def attribute_counts(t: Trial) -> DataFrame:
    return n_rows(t.attribute_fields("availability", "assertion", "method"),
                  "name", "availability", "assertion", "method")


@query
def attribute_predicates(t: Trial) -> DataFrame:
    attributes = t.attribute_fields("availability", "assertion", "method", "prior_availability")
    a = F.struct(*[F.col(c) for c in attributes.columns])
    return attributes.groupBy("name").agg(*[F.count_if(p(a)).alias(n) for n, p in (
        ("n_observed", attrs.observed), ("n_present", attrs.present),
        ("n_negative", attrs.documented_negative), ("n_silent", attrs.is_silent),
        ("n_from_text", attrs.from_text))],
        F.count_if(attrs.structured_availability(a) == "observed").alias("n_structured"))


@query
def route_descriptions(t: Trial) -> DataFrame:
    return n_rows(t.records.select("study_id", attrs.route(F.col("modifiers")[MUCOSAL])
                                   .alias("route")), "study_id", "route")


@query
def evidence_spans(t: Trial) -> DataFrame:
    """Distinct evidence pointers per record."""
    return n_rows(t.spans(), "record_id")


@query
def surface_values(t: Trial) -> DataFrame:
    """Mention surfaces without a cue, resolved through the catalogue."""
    plain = t.mentions().filter(F.col("rule").isin(
        "direct_phrase", "same_sentence", "comment_record"))
    found = aggregates.normalize_surface(plain, "surface", MUCOSAL,
                                         t.config.surface_forms(MUCOSAL))
    return n_rows(found.select("surface", F.col(f"{MUCOSAL}_value").alias("catalogue_value")),
                  "surface", "catalogue_value")


# -- filters and predicates --------------------------------------------------------------

@query
def cohort_retrieval(t: Trial) -> DataFrame:
    """Exact filters over the flat table with verdicts, first fifty by record id."""
    return t.retrieve(V2, concept="CUTANEOUS", assertion=["present", "absent"],
                      method=["direct", "extracted"], window=(0, 30), top_k=50).select(
        "record_id", "study_id", "concept", "assertion", "value", "method", "confidence",
        "exposure_offset_days", "verdict", "definition")


@query
def evidence_search(t: Trial) -> DataFrame:
    return t.retrieve(assertion=["absent"], availability=["observed"], method=["extracted"],
                      top_k=None).select("record_id", "assertion", "source_variable", "confidence")


@query
def record_listing(t: Trial) -> DataFrame:
    _, rows = aggregates.list_records(t.records, MUCOSAL, limit=25, profile="P_both",
                                      assertion="uncertain")
    return rows.select("record_id", "reported_term", "code", "concept", "modifier_assertion",
                       "modifier_value", "modifier_method", "exposure_offset_days")


@query
def record_listing_all(t: Trial) -> DataFrame:
    """The listing without its limit."""
    _, rows = aggregates.list_records(t.records, MUCOSAL, limit=None, profile="P_both", assertion="uncertain")
    return rows.select("record_id", "reported_term", "code", "concept", "modifier_assertion",
                       "modifier_value", "modifier_method", "exposure_offset_days")


@query
def record_listing_total(t: Trial) -> DataFrame:
    total, _ = aggregates.list_records(t.records, MUCOSAL, profile="P_negated", method="extracted")
    return total


@query
def study_restriction(t: Trial) -> DataFrame:
    return n_rows(t.assignments(V2, ["STUDY-A", "STUDY-B"]), "study_id", "verdict")


@query
def concept_group_scope(t: Trial) -> DataFrame:
    members = t.config.expand(["CUTANEOUS"])
    return n_rows(t.structured.filter(F.col("concept_id").isin(*members)), "study_id",
                  "concept_id")


@query
def supportability_screen(t: Trial) -> DataFrame:
    """Status from metadata, beside how many events it opens or closes."""
    events = t.snapshot.ae.groupBy(F.col("STUDYID").alias("study_id")).agg(
        F.count(F.lit(1)).alias("n_events"))
    return t.supportability(MUCOSAL).join(events, "study_id").select(
        "study_id", "profile", "status", F.array_join("homes", ",").alias("homes"), "n_events")


@query
def both_routes(t: Trial) -> DataFrame:
    eligible = t.config.both_routes(MUCOSAL)
    return n_rows(t.structured.filter(F.col("profile").isin(*eligible)), "study_id", "profile")


@query
def askable_records(t: Trial) -> DataFrame:
    """Records whose prose may be asked, and those with an open modifier, per study."""
    open_ = ~F.col("modifiers")[MUCOSAL]["availability"].isin(*fixed.SETTLED)
    return t.structured.groupBy("study_id").agg(
        F.count_if(extract.askable(t.config, MUCOSAL)).alias("n_askable"),
        F.count_if(open_).alias("n_open"))


@query
def boundary_audit(t: Trial) -> DataFrame:
    """Open structured answers beside prose, where every second event of a subject's form is unreadable."""
    spoilt = t.snapshot.ae.withColumn("AEMUCOS", F.when(
        F.col("AEMUCOS").isNotNull() & (F.col("AESEQ").cast("int") % 2 == 0), "see form").otherwise(F.col("AEMUCOS")))
    return extract.boundary_violations(Trial(replace(t.snapshot, ae=spoilt), t.config).structured, t.config)


@query
def request_audit(t: Trial) -> DataFrame:
    """One request per record against the records: which may not be sent, and why."""
    requests = t.structured.select(
        "record_id", F.lit(MUCOSAL).alias("modifier"), F.lit("reported_term").alias("source_kind"),
        F.when(F.col("concept_id") == "NAUSEA", "coded_concept_variation")
        .otherwise("language_variation").alias("mechanism"))
    return n_rows(extract.request_violations(requests, t.structured), "reason")


@query
def coded_field_audit(t: Trial) -> DataFrame:
    """What the audit says of a reader that also recodes nausea; the built-in one changes nothing."""
    rules = extract.rules_reader(t.config)

    def recoding(df: DataFrame, text: str, kind: str, modifiers: list) -> DataFrame:
        read = rules(df, text, kind, modifiers)
        if "coded_event" not in read.columns:
            return read
        return read.withColumn("coded_event", F.when(F.col("concept_id") == "NAUSEA", F.col("coded_event").withField(
            "code", F.lit("Queasiness"))).otherwise(F.col("coded_event")))

    return n_rows(extract.coded_changes(t.structured, t.config, t.snapshot.documents, recoding), "field")


@query
def term_only_verdicts(t: Trial) -> DataFrame:
    """Verdicts when prose reading is limited to the reported term."""
    return n_rows(t.ablation(V2).withColumnRenamed("reported_term", "verdict"),
                  "study_id", "verdict")


# -- prose ------------------------------------------------------------------------------

@table_query
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    split = docs.withColumn("s", F.expr(text.sentences("text")))
    return split.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.expr(
        "aggregate(s, 0L, (acc, x) -> acc + length(x.text))").alias("n_chars"))


@table_query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.expr(text.count_words("text")).cast("bigint").alias("n_words"))


@table_query
def folded_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants folded in every document; the digest covers the whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(F.expr(text.fold("text"))).alias("digest"))


@scan_query
def event_mentions(t: Trial) -> DataFrame:
    """Event names found in each reported term."""
    found = F.expr(MentionReader(t.config).event_hits("term"))
    return t.snapshot.ae.select(F.col("AESPID").alias("source_record_id"),
                                F.col("AETERM").alias("term")).withColumn("e", found).select(
        "source_record_id", F.size("e").cast("bigint").alias("n_events"),
        F.get("e", F.lit(0))["s"].alias("first_start"), F.get("e", F.lit(0))["e"].alias("first_end"),
        F.get("e", F.lit(0))["c"].alias("first_concept"))


@scan_query
def term_assertions(t: Trial) -> DataFrame:
    """What each reported term says by itself, whatever the structured side holds."""
    best = F.expr(MentionReader(t.config).best("term", MUCOSAL, "'reported_term'"))
    return t.snapshot.ae.select(F.col("AESPID").alias("source_record_id"),
                                F.col("AETERM").alias("term")).select(
        "source_record_id", F.explode(F.array(best)).alias("b")).select(
        "source_record_id", "b.assertion", "b.value", "b.confidence", "b.rule")


@query
def mention_table(t: Trial) -> DataFrame:
    return t.mentions().select("mention_id", "doc_id", "study_id", "source_kind", "assertion",
                               "value", "surface", "confidence")


@query
def enriched_modifiers(t: Trial) -> DataFrame:
    a = F.col("modifiers")[MUCOSAL]
    return t.records.select("record_id", *[a[f].alias(f) for f in (
        "assertion", "availability", "value", "method", "source_variable", "confidence",
        "prior_availability")])


@query
def extraction_statistics(t: Trial) -> DataFrame:
    return extract.attempt_summary(t.attempts)


@scan_query
def answer_validation(t: Trial) -> DataFrame:
    """Answers made up per record by arithmetic, checked like any outside answer."""
    number = F.col("AESEQ").cast("int")
    length = F.length("AETERM")
    body = F.struct(
        F.when(number == 1, "probably").when(number == 2, "").otherwise("Present").alias("assertion"),
        F.when(number == 3, "SOMEWHERE").when(number == 4, "oral  ulceration").when(
            number == 5, "ORAL").alias("value"),
        F.lit(0).alias("start"),
        F.when(number == 6, length + 1).otherwise(length).alias("end"),
        F.when(number == 7, 0.66).alias("confidence"))
    answers = t.snapshot.ae.select(
        F.col("AESPID").alias("doc_id"), F.col("AETERM").alias("text"),
        F.lit(MUCOSAL).alias("modifier"), F.to_json(body).alias("payload"))
    return extract.validate_answers(answers, t.config).select(
        "doc_id", "outcome", "assertion", "value", "end", "confidence")


# -- evaluation ----------------------------------------------------------------------------

@query
def structured_incidence(t: Trial) -> DataFrame:
    """Incidence of cutaneous events with mucosal involvement within thirty days of first
    exposure, per study, from structured evidence."""
    return _denominators(aggregates.denominators(t.structured_assignments(V1)))


def _denominators(df: DataFrame) -> DataFrame:
    return df.select("study_id", "profile", "n_total", *aggregates.VERDICT_COUNTS,
                     "n_ascertainable", "ascertainable_fraction", "incidence")


@query
def structured_verdicts(t: Trial) -> DataFrame:
    return t.structured_assignments(V1).select("record_id", "verdict", "deciding_criterion")


@query
def narrative_verdicts(t: Trial) -> DataFrame:
    return t.assignments(V2).select("record_id", "verdict", "deciding_criterion")


@query
def graded_toxicity_verdicts(t: Trial) -> DataFrame:
    return t.assignments(TOXICITY).select("record_id", "verdict", "deciding_criterion")


@query
def criterion_findings(t: Trial) -> DataFrame:
    found = t.assignments(V2).select(F.explode("findings").alias("f")).select("f.*")
    return n_rows(found, "name", "satisfied", "verdict", "method", "source_variable")


@query
def toxicity_findings(t: Trial) -> DataFrame:
    found = t.assignments(TOXICITY).select(F.explode("findings").alias("f")).select("f.*")
    return n_rows(found, "name", "satisfied", "verdict", "availability")


@query
def text_dependent_cases(t: Trial) -> DataFrame:
    return evaluate.text_dependent_cases(t.assignments(V2)).select("record_id", "study_id")


@query
def cases_by_subject(t: Trial) -> DataFrame:
    return evaluate.cases_by_subject(t.assignments(V2))


# -- aggregation ------------------------------------------------------------------------------

@query
def narrative_denominators(t: Trial) -> DataFrame:
    return _denominators(aggregates.denominators(t.assignments(V2), overall=True))


@query
def verdict_counts(t: Trial) -> DataFrame:
    return aggregates.verdict_counts(t.assignments(V2))


@query
def evidence_routes(t: Trial) -> DataFrame:
    return aggregates.evidence_routes(t.assignments(V2))


@query
def cohort_report(t: Trial) -> DataFrame:
    return aggregates.cohort_report(t.assignments(V2))


@query
def case_export(t: Trial) -> DataFrame:
    return aggregates.export(t.assignments(V2)).select(
        "subject_id", "study_id", "record_id", "status", "verdict", "definition",
        F.array_join("evidence_route", ",").alias("evidence_route"))


@query
def record_counters(t: Trial) -> DataFrame:
    return aggregates.record_counters(t.records, MUCOSAL)


@query
def exposure_timing(t: Trial) -> DataFrame:
    return aggregates.exposure_timing(t.structured)


@query
def exposure_coverage(t: Trial) -> DataFrame:
    return aggregates.exposure_totals(t.structured)


@query
def covariate_counts(t: Trial) -> DataFrame:
    return aggregates.covariates(t.snapshot.cohort(), t.snapshot.dm)


@query
def cumulative_dose(t: Trial) -> DataFrame:
    """Dose-days before onset for every record; null where nothing counts."""
    asked = t.structured.select("record_id", "subject_id", F.col("onset.value").alias("onset"))
    return asked.join(anchors.dose_before(asked, t.snapshot.ex), ["subject_id", "onset"],
                      "left").select("record_id", "dose_days", "n_exposures")


# -- scoring ------------------------------------------------------------------------------------

@query
def verdict_confusion(t: Trial) -> DataFrame:
    return scoring.phenotype_cells(t.assignments(V2), t.snapshot.gold())


@query
def verdict_labels(t: Trial) -> DataFrame:
    """Precision, recall and F1 per verdict."""
    rows = scoring.with_gold(t.assignments(V2), t.snapshot.gold(), "true_verdict")
    return stats.per_label(stats.confusion(rows, "true_verdict", "verdict"))


@query
def phenotype_scores(t: Trial) -> DataFrame:
    return scoring.case_metrics(scoring.phenotype_cells(t.assignments(V2), t.snapshot.gold()),
                                "scope", "key")


@query
def site_slot_scores(t: Trial) -> DataFrame:
    """Slot scores of the mucosal site read from prose."""
    a = F.col("modifiers")[MUCOSAL]
    rows = scoring.with_gold(t.records.select("source_record_id", "study_id",
                                              a["value"].alias("predicted")),
                             t.snapshot.gold(), "text_value")
    counted = rows.select("study_id", *stats.slot_counts(F.col("text_value"), F.col("predicted")))
    return counted.groupBy("study_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(
        "study_id", *stats.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query
def criteria_set_scores(t: Trial) -> DataFrame:
    """Recorded seriousness criteria against those read, as sets."""
    read = F.map_keys(F.map_filter("seriousness_criteria", lambda k, a: attrs.present(a)))
    recs = t.structured.select(F.col("source_record_id").alias("AESPID"), read.alias("read"))
    cells = F.filter(F.transform(F.split(F.coalesce("AESCAT", F.lit("")), r"\|"), values.strip),
                     lambda c: c != "")
    rows = t.snapshot.ae.select("AESPID", cells.alias("written")).join(recs, "AESPID")
    counted = rows.select(*stats.set_counts(F.col("written"), F.col("read")))
    return counted.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(
        *stats.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query
def assertion_confusion(t: Trial) -> DataFrame:
    return scoring.assertion_cells(scoring.assertion_rows(t.records, t.snapshot.gold(), MUCOSAL))


@query
def assertion_summary(t: Trial) -> DataFrame:
    return scoring.assertion_summary(scoring.assertion_cells(
        scoring.assertion_rows(t.records, t.snapshot.gold(), MUCOSAL)))


@query
def assertion_examples(t: Trial) -> DataFrame:
    return scoring.assertion_examples(scoring.assertion_rows(
        t.records, t.snapshot.gold(), MUCOSAL)).drop("note")


@query
def representation_invariance(t: Trial) -> DataFrame:
    return scoring.invariance(scoring.truth_agreement(scoring.renderings(
        t.assignments(V2), t.snapshot.gold())))


@query
def discordant_truths(t: Trial) -> DataFrame:
    return scoring.discordant(scoring.truth_agreement(scoring.renderings(
        t.assignments(V2), t.snapshot.gold()))).drop("example_reason")


@query
def study_holdout(t: Trial) -> DataFrame:
    held = scoring.holdout_split(t.config)
    return scoring.case_metrics(scoring.holdout_cells(t.assignments(V2), t.snapshot.gold(), held),
                                "scope", "key")


@query
def holdout_drop(t: Trial) -> DataFrame:
    held = scoring.holdout_split(t.config)
    drops = scoring.holdout_drop(scoring.case_metrics(scoring.holdout_cells(
        t.assignments(V2), t.snapshot.gold(), held), "scope", "key"))
    return drops.select(*[stats.round4(F.col(c)).alias(c) for c in drops.columns])


@query
def mention_ranking(t: Trial) -> DataFrame:
    """Mentions ranked by confidence per study against records where the modifier was true."""
    ranked = t.mentions().select(F.col("study_id").alias("query_id"),
                                 F.col("source_record_id").alias("item_id"),
                                 F.col("confidence").alias("score"))
    relevant = t.snapshot.gold().filter("true_assertion = 'present'").select(
        F.col("study_id").alias("query_id"), F.col("source_record_id").alias("item_id"))
    # ranked rows are read several times, so they are written once
    return scoring.ranking_metrics(written(ranked, "ranked-mentions"), relevant, 20)


@query
def silver_comparisons(t: Trial) -> DataFrame:
    return t.silver().select("source_record_id", "structured_assertion", "extracted_assertion",
                             "extracted_value", "extracted_confidence", "agreement")


@query
def silver_metrics(t: Trial) -> DataFrame:
    return silver.metrics(t.silver())


@query
def silver_by_assertion(t: Trial) -> DataFrame:
    return silver.by_assertion(t.silver())


@query
def silver_reliability(t: Trial) -> DataFrame:
    return silver.reliability(t.silver())


@query
def silver_calibration(t: Trial) -> DataFrame:
    return silver.calibration(t.silver())


@query
def adjudication_queue(t: Trial) -> DataFrame:
    return n_rows(silver.adjudication_queue(t.silver()), "queue_reason")


@query
def ablation_stages(t: Trial) -> DataFrame:
    return ablation.stage_metrics(t.ablation(V2)).drop("position")


@query
def ablation_increments(t: Trial) -> DataFrame:
    return ablation.increments(t.ablation(V2)).drop("position")


@query
def ablation_decision(t: Trial) -> DataFrame:
    return ablation.headline(ablation.increments(t.ablation(V1)))


@query
def evaluation_bundle(t: Trial) -> DataFrame:
    return t.evaluation(V2)


# -- order-dependent -----------------------------------------------------------------------------

@scan_query
def first_exposure(t: Trial) -> DataFrame:
    return anchors.first_exposure(t.snapshot.ex).select("subject_id", text_date("anchor_date"))


def _changes(t: Trial, rule: str) -> DataFrame:
    return anchors.dose_changes(t.snapshot.ex, rule).select(
        "subject_id", text_date("day"), whole("seq"), "before", "dose")


@scan_query
def dose_increases(t: Trial) -> DataFrame:
    return _changes(t, "dose_increase")


@scan_query
def dose_decreases(t: Trial) -> DataFrame:
    return _changes(t, "dose_decrease")


@query
def latest_anchor(t: Trial) -> DataFrame:
    """The last escalation on or before onset, per record."""
    asked = t.structured.select("record_id", "subject_id", F.col("onset.value").alias("onset"))
    return anchors.resolve(asked, t.snapshot.ex, t.config, "dose_escalation",
                           "most_recent_before_onset").select("record_id",
                                                              text_date("anchor_date"))


@query
def episode_members(t: Trial) -> DataFrame:
    return t.episode_members.select("record_id", "concept", whole("ordinal"), "gap")


@query
def episode_table(t: Trial) -> DataFrame:
    return t.episodes.select("episode_id", whole("episode_number"), "study_id", "subject_id",
                             "concept", "n_records", text_date("first_onset"),
                             text_date("last_onset"), "rule", "confidence", "review_required")


@query
def episode_rules(t: Trial) -> DataFrame:
    return episodes.rule_counts(t.episodes)


@query
def record_episode(t: Trial) -> DataFrame:
    return episodes.record_episodes(t.episode_members, t.episodes)


# -- retrieval -------------------------------------------------------------------------------------

@query
def flat_records(t: Trial) -> DataFrame:
    return t.flat().select("record_id", "study_id", "concept", "code", "reconciliation",
                           "assertion", "availability", "value", "method", "source_variable",
                           "severity", "grade", "exposure_offset_days", text_date("onset"))


@query
def verdict_upsert(t: Trial) -> DataFrame:
    """Two definitions written in turn; the second wins where both judged."""
    flat = retrieval.attach_verdicts(t.flat(), t.assignments(V1))
    flat = retrieval.attach_verdicts(flat, t.assignments(TOXICITY))
    return n_rows(flat, "definition_id", "definition_version", "verdict")


@query
def mention_search(t: Trial) -> DataFrame:
    return t.discover("oral delay", assertion=["present"], top_k=40).select(
        "mention_id", "value", F.round("score", 6).alias("score"), "candidate")


@query
def mention_browse(t: Trial) -> DataFrame:
    return t.discover(assertion=["absent"], studies=["STUDY-E", "STUDY-G"], top_k=30).select(
        "mention_id", "assertion", "score")


@query
def mention_search_all(t: Trial) -> DataFrame:
    """Every mention that the search of ``mention_search`` finds."""
    return t.discover("oral delay", assertion=["present"]).select(
        "mention_id", "value", F.round("score", 6).alias("score"), "candidate")


@query
def mention_browse_all(t: Trial) -> DataFrame:
    return t.discover(assertion=["absent"], studies=["STUDY-E", "STUDY-G"]).select(
        "mention_id", "assertion", "score")


def document_index(spark: SparkSession, sf_dir: str) -> text_search.TextIndex:
    """The index of the documents table, built once a session."""
    path = f"{sf_dir}/documents.parquet"
    return once(spark, "document-index", [path], lambda: text_search.build(
        spark.read.parquet(path).select("doc_id", F.col("text").alias("full_text"))))


def _search(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return text_search.bm25(document_index(spark, sf_dir), text).select(
        "doc_id", F.round("score", 6).alias("score"))


@table_query
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents table."""
    return _search(spark, sf_dir, "the of")


@table_query
def document_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, a beginning and an excluded word, without regard to diacritics."""
    return _search(spark, sf_dir, '"de la" cion* -Licensed')


@table_query
def document_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of three things."""
    return _search(spark, sf_dir, '"mit license" OR apache version OR "de la" -cion*')


@table_query
def index_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the index with their documents, places and the sum of first places."""
    return document_index(spark, sf_dir).postings.groupBy("term").agg(
        F.count("*").alias("n_docs"), F.sum("tf").cast("bigint").alias("n_places"),
        F.sum(F.element_at("positions", 1)).cast("bigint").alias("first_places"))


@table_query
def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases in every whole document, by the reader of mentions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    asked = ("general public license", "apache license", "licensed under", "mit license")
    found = text.hits("t", [text.phrase_pattern(p) for p in asked], "h")
    return docs.select("doc_id", F.inline(F.expr(found))).groupBy("doc_id", F.col("k").alias("phrase")).agg(
        F.count("*").alias("n"), F.sum("s").cast("bigint").alias("starts"), F.sum("e").cast("bigint").alias("ends"))


@table_query
def dense_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors reordered by similarity to the first one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = vectors.filter("vec_id = 0").select(F.col("embedding").alias("query"))
    ranked = retrieval.rerank(vectors.select("vec_id", "label"), vectors, first, key="vec_id")
    return ranked.select("vec_id", "label", F.round("score", 5).alias("score"))


# -- runs, comparison, trace --------------------------------------------------------------------------

@query
def definition_comparison(t: Trial) -> DataFrame:
    return t.compare(V1, V2, SCOPE).select("record_id", "verdict_a", "verdict_b", "deciding_a",
                                           "deciding_b", "case_change")


@query
def comparison_summary(t: Trial) -> DataFrame:
    return compare.summary(t.compare(V1, V2, SCOPE))


@query
def case_sets(t: Trial) -> DataFrame:
    return compare.case_sets(t.compare(V1, V2, SCOPE))


@query
def manifest_preview(t: Trial) -> DataFrame:
    return runs.manifest_preview(t, t.definition(V2))


@query
def results_hash(t: Trial) -> DataFrame:
    return runs.results_hash(t.assignments(V2))


@query
def results_hash_flat(t: Trial) -> DataFrame:
    """The same hash over the columns of a result that are plain cells."""
    return runs.results_hash(t.assignments(V2), ("record_id", "subject_id", "study_id", "profile", "verdict",
                                                 "deciding_criterion", "definition_id", "definition_version"))


@query
def number_trace(t: Trial) -> DataFrame:
    """The chain behind the case count of the narrative definition, without a saved run."""
    d = t.definition(V2)
    manifest = {"manifest_id": "preview", "actor": "query",
                "normalizer_version": t.config.normalizer_version,
                "extractor_version": t.config.extractor_version, "data_snapshot_id": "unsaved",
                "definition_id": d.id, "definition_version": d.version,
                "definition_status": d.status, "definition_hash": d.content_hash}
    return trace.trace_number(t.assignments(V2), t.attributes, t.records, manifest, "case count")
