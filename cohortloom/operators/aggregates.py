"""Counts behind every reported number: denominators, routes, timing, covariates, export.

Reports over one population are single passes: a row emits the counters it
belongs to and one grouped count adds them up, with map-side combine.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import attrs, values
from ..functions.stats import count_if, ratio, round4
from .evaluate import used_text

VERDICT_COUNTS = [f"n_{v}" for v in fixed.VERDICTS]


def _entries(*pairs: tuple[str | Column, ...]) -> Column:
    """An array of counter entries; a null entry is not counted."""
    return F.array_compact(F.array(*pairs))


def _entry(counter: str, key: Column, scope: Column | None = None, when: Column | None = None
           ) -> Column:
    made = F.struct(F.lit(counter).alias("counter"),
                    (F.lit("ALL") if scope is None else scope).alias("scope"), key.alias("key"))
    return made if when is None else F.when(when, made)


def count_entries(df: DataFrame, entries: Column) -> DataFrame:
    return df.select(F.explode(entries).alias("e")).groupBy("e.counter", "e.scope", "e.key").agg(
        F.count(F.lit(1)).alias("n"))


# -- verdicts and denominators --------------------------------------------------

def denominator_columns() -> list[Column]:
    """Rates from the four counts; incidence is null when nobody is ascertainable."""
    known = F.col("n_case") + F.col("n_non_case")
    return [known.alias("n_ascertainable"),
            round4(ratio(known, F.col("n_total"))).alias("ascertainable_fraction"),
            round4(ratio(F.col("n_case"), known, None)).alias("incidence")]


def denominators(assignments: DataFrame, overall: bool = False) -> DataFrame:
    """Per study, optionally with the pooled row ``ALL``: counts, fraction and incidence."""
    counts = [F.count(F.lit(1)).alias("n_total"), *[
        count_if(F.col("verdict") == v).alias(f"n_{v}") for v in fixed.VERDICTS]]
    if not overall:
        return assignments.groupBy("study_id", "profile").agg(*counts).select(
            "*", *denominator_columns())
    # both groupings from one pass over the assignments
    rows = assignments.groupingSets([["study_id", "profile"], []], "study_id", "profile").agg(
        F.grouping_id().alias("level"), *counts)
    pooled = F.col("level") > 0
    return rows.select(
        F.when(pooled, "ALL").otherwise(F.col("study_id")).alias("study_id"),
        F.when(pooled, "").otherwise(F.col("profile")).alias("profile"), "n_total",
        *VERDICT_COUNTS).select("*", *denominator_columns())


def verdict_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def evidence_routes(assignments: DataFrame) -> DataFrame:
    """Which source variables and methods stand behind the cases."""
    routes = F.concat(
        F.transform(F.map_values("attribute_sources"), lambda v: F.struct(
            F.lit("source_variable").alias("route"), v.alias("key"))),
        F.transform(F.map_values("attribute_methods"), lambda v: F.struct(
            F.lit("method").alias("route"), v.alias("key"))))
    return assignments.filter("verdict = 'case'").select(F.explode(routes).alias("r")).groupBy(
        "r.route", "r.key").agg(F.count(F.lit(1)).alias("n"))


def cohort_report(assignments: DataFrame) -> DataFrame:
    """Verdicts overall and per study with the routes behind cases, in one pass."""
    case = F.col("verdict") == "case"

    def route(counter: str, column: str) -> Column:
        return F.when(case, F.transform(F.map_values(column), lambda v: F.struct(
            F.lit(counter).alias("counter"), F.lit("ALL").alias("scope"), v.alias("key"))))
    none = F.array().cast("array<struct<counter:string,scope:string,key:string>>")
    entries = F.concat(
        _entries(_entry("verdict", F.col("verdict")),
                 _entry("study_verdict", F.col("verdict"), F.col("study_id"))),
        F.coalesce(route("source_variable", "attribute_sources"), none),
        F.coalesce(route("method", "attribute_methods"), none))
    return count_entries(assignments, entries)


def text_dependence(assignments: DataFrame) -> DataFrame:
    """Cases per study, and how many rest on prose."""
    return assignments.filter("verdict = 'case'").groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n_case"),
        count_if(used_text(F.col("attribute_methods"))).alias("n_text_dependent"))


def export(assignments: DataFrame) -> DataFrame:
    """Case / non-case export; unsettled records keep a null status."""
    return assignments.select(
        "subject_id", "study_id", "record_id",
        F.when(F.col("verdict") == "case", 1).when(F.col("verdict") == "non_case", 0)
        .alias("status"), "verdict",
        F.concat("definition_id", F.lit(".v"), "definition_version").alias("definition"),
        "definition_hash",
        F.array_sort(F.array_distinct(F.map_values("attribute_methods"))).alias("evidence_route"))


# -- record-level counters --------------------------------------------------------

def record_counters(recs: DataFrame, modifier: str) -> DataFrame:
    """Routes, assertions, availabilities and reconciliation outcomes per profile."""
    a, profile = F.col("modifiers")[modifier], F.col("profile")
    return count_entries(recs, _entries(
        _entry("route", F.coalesce(a["method"], a["availability"]), profile),
        _entry("assertion", F.coalesce(a["assertion"], F.lit("silent")), profile),
        _entry("availability", a["availability"], profile),
        _entry("reconciliation", F.col("coded_event.reconciliation"), profile,
               F.col("coded_event").isNotNull())))


def time_bucket(offset: Column) -> Column:
    """Days since exposure. Negative offsets fall in the first bucket, as declared."""
    return (F.when(offset <= 7, "0-7").when(offset <= 30, "8-30").when(offset <= 90, "31-90")
            .otherwise("91+"))


def exposure_timing(recs: DataFrame) -> DataFrame:
    """Records per time bucket; ``before_exposure`` says how many offsets were negative."""
    offset = F.col("exposure_relation.value")
    return recs.select(offset.alias("offset"), F.when(
        offset.isNull(), "unresolved").otherwise(time_bucket(offset)).alias("bucket")).groupBy(
        "bucket").agg(F.count(F.lit(1)).alias("n"),
                      count_if(F.col("offset") < 0).alias("before_exposure"))


def exposure_totals(recs: DataFrame) -> DataFrame:
    """Subjects, records and how many offsets were resolved."""
    per_subject = recs.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("exposure_relation.value").alias("known"))
    return per_subject.agg(
        F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("records"),
        F.sum("known").alias("offsets_resolved"),
        (F.sum("n") - F.sum("known")).alias("offsets_unresolved"))


def covariates(cohort: DataFrame, dm: DataFrame) -> DataFrame:
    """Subject counts by arm, sex and country; a missing value counts as unknown."""
    names = {"arm": "ARM", "sex": "SEX", "country": "COUNTRY"}
    known = dm.groupBy(F.col("USUBJID").alias("subject_id")).agg(
        F.min(F.struct(*names.values())).alias("d"))
    joined = cohort.join(known, "subject_id", "left")
    entries = F.array(*[F.struct(
        F.lit(n).alias("covariate"),
        F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.lit("unknown")).alias("value"))
        for n, c in names.items()])
    return joined.select(F.explode(entries).alias("e")).groupBy("e.covariate", "e.value").agg(
        F.count(F.lit(1)).alias("n"))


# -- listings ---------------------------------------------------------------------

def record_summary(recs: DataFrame, modifier: str) -> DataFrame:
    """The flat listing row of a record."""
    a, coded = F.col("modifiers")[modifier], F.col("coded_event")
    return recs.select(
        "record_id", "source_record_id", "study_id", "subject_id", "profile",
        F.col("reported_term.value").alias("reported_term"), coded["code"].alias("code"),
        coded["dictionary_version"].alias("dictionary_version"),
        coded["reconciled_to"].alias("reconciled_to"),
        coded["reconciliation"].alias("reconciliation"), F.col("concept_id").alias("concept"),
        a["assertion"].alias("modifier_assertion"),
        F.coalesce(a["availability"], F.lit("unresolved")).alias("modifier_availability"),
        a["value"].alias("modifier_value"), a["method"].alias("modifier_method"),
        a["source_variable"].alias("modifier_source"),
        F.col("exposure_relation.value").alias("exposure_offset_days"))


LISTING_FILTERS = {"profile": "profile", "assertion": "modifier_assertion",
                   "availability": "modifier_availability", "method": "modifier_method",
                   "reconciliation": "reconciliation"}


def list_records(recs: DataFrame, modifier: str, limit: int | None = None, **filters: str
                 ) -> tuple[DataFrame, DataFrame]:
    """The whole count of matching records and the first rows in stable order."""
    rows = record_summary(recs, modifier)
    for name, wanted in filters.items():
        if wanted is not None:
            rows = rows.filter(F.col(LISTING_FILTERS[name]) == wanted)
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    ordered = rows.orderBy("study_id", "subject_id", "source_record_id")
    return total, ordered.limit(limit) if limit else ordered


def record_detail(attributes: DataFrame, record_id: str) -> DataFrame:
    """Every attribute of one record, with its route and the derived predicates."""
    a = F.struct(*[F.col(c) for c in attributes.columns])
    return attributes.filter((F.col("record_id") == record_id)
                             | (F.col("source_record_id") == record_id)).select(
        *attributes.columns, attrs.route(a).alias("route"), attrs.observed(a).alias("observed"),
        attrs.documented_negative(a).alias("documented_negative"))


def normalize_surface(df: DataFrame, column: str, modifier: str, forms: dict[str, str]
                      ) -> DataFrame:
    """Catalogue value of a surface form; null for a form nobody declared."""
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return df.withColumn(f"{modifier}_value", F.try_element_at(
        table, values.surface_key(F.col(column))))


def study_filter(df: DataFrame, studies: Sequence[str] | None) -> DataFrame:
    """Limit to some studies; study_id is a source column, so the filter reaches the scan."""
    return df.filter(F.col("study_id").isin(*studies)) if studies else df
