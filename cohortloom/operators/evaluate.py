"""Case definitions over records: four verdicts, with the finding that decided.

The verdict is a short chain over one small struct of criterion outcomes. The
findings with their reasons and spans are separate columns, so a count of
verdicts never builds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..config import TrialConfig
from ..definitions import Definition
from ..functions import attrs
from ..schema import FINDING, SCALAR_ATTRIBUTES, SPAN
from .anchors import dose_before

SATISFIED = "satisfied"


def in_concept_set(recs: DataFrame, definition: Definition, config: TrialConfig) -> DataFrame:
    """Records in scope; a record outside the set gives no row, not a negative."""
    include = [c for c in config.expand(definition.include) if c not in definition.exclude]
    return recs.filter(F.col("concept_id").isin(*include))


# -- outcome per criterion: the verdict of an unsatisfied one, else SATISFIED ----

def _modifier_outcome(rule, d: Definition, modifiers: str) -> Column:
    a = F.col(modifiers)[rule.name]
    method = a["method"]
    extracted = attrs.from_text(a)
    chain = F.when(a.isNull() | attrs.is_silent(a), rule.on_unavailable)
    chain = chain.when(~F.coalesce(method.isin(*rule.accept_methods), F.lit(False)),
                       d.on_missing_modifier)
    if rule.accept_sources is not None:
        chain = chain.when(~F.coalesce(a["source"].isin(*rule.accept_sources), F.lit(False)),
                           d.on_missing_modifier)
    if d.requires_span:
        chain = chain.when(extracted & (F.size(a["evidence"]) == 0), "review")
    chain = chain.when(extracted & (a["confidence"] < d.min_confidence), d.below_threshold)
    return (chain.when(a["assertion"] == rule.require_assertion, SATISFIED)
            .when(a["assertion"] == "uncertain", d.on_uncertain).otherwise("non_case"))


def _window_outcome(d: Definition) -> Column:
    offset = F.col("exposure_relation.value")
    return (F.when(offset.isNull(), d.temporal.on_unresolved)
            .when(offset.between(d.temporal.minimum, d.temporal.maximum), SATISFIED)
            .otherwise("non_case"))


def _graded(d: Definition, modifiers: str = "modifiers") -> Column:
    name = d.grade.attribute
    return F.col(name) if name in SCALAR_ATTRIBUTES else F.col(modifiers)[name]


def _grade_outcome(d: Definition, modifiers: str) -> Column:
    value = _graded(d, modifiers)["value"].try_cast("int")
    return (F.when(value.isNull(), d.grade.on_unavailable)
            .when(value >= d.grade.minimum, SATISFIED).otherwise("non_case"))


def _dose_outcome(d: Definition) -> Column:
    total = F.col("dose_days")
    return (F.when(total.isNull(), d.dose.on_unresolved)
            .when(total >= d.dose.minimum, SATISFIED).otherwise("non_case"))


def outcomes(d: Definition, modifiers: str = "modifiers") -> Column:
    """One struct with the outcome of every criterion, read from one modifier map."""
    found = [F.lit(SATISFIED).alias("concept")]
    found += [_modifier_outcome(m, d, modifiers).alias(m.name) for m in d.modifiers]
    if d.temporal:
        found.append(_window_outcome(d).alias("temporal"))
    if d.grade:
        found.append(_grade_outcome(d, modifiers).alias(d.grade.attribute))
    if d.dose:
        found.append(_dose_outcome(d).alias("cumulative_exposure"))
    return F.struct(*found)


def decide(d: Definition, criteria: str = "criteria") -> tuple[Column, Column]:
    """Verdict and deciding criterion: the worst unsatisfied outcome, first in order."""
    verdict, deciding = F.lit("case"), F.lit(None).cast("string")
    for v in reversed(fixed.VERDICT_PRECEDENCE):
        first = F.lit(None).cast("string")
        for name in reversed(d.criteria):
            first = F.when(F.col(f"{criteria}.{name}") == v, name).otherwise(first)
        verdict = F.when(first.isNotNull(), v).otherwise(verdict)
        deciding = F.when(first.isNotNull(), first).otherwise(deciding)
    return verdict, deciding


# -- findings ------------------------------------------------------------------

def _finding(name: str, outcome: Column, reason: Column, a: Column | None = None,
             **given) -> Column:
    """One finding; fields come from the attribute unless given."""
    def field(key: str) -> Column:
        if key in given:
            value = given[key]
            return value if isinstance(value, Column) else F.lit(value)
        if a is None:
            return F.lit(None)
        return a["evidence"] if key == "spans" else a[key].cast("string") \
            if key == "value" else a[key]
    satisfied = outcome == SATISFIED
    return F.struct(
        F.lit(name).alias("name"), satisfied.alias("satisfied"),
        F.when(satisfied, "case").otherwise(outcome).alias("verdict"),
        field("assertion").cast("string").alias("assertion"),
        field("availability").cast("string").alias("availability"),
        field("value").cast("string").alias("value"), field("method").cast("string").alias("method"),
        field("source").cast("string").alias("source"),
        field("source_variable").cast("string").alias("source_variable"),
        field("confidence").cast("double").alias("confidence"), reason.alias("reason"),
        F.coalesce(field("spans").cast(T.ArrayType(SPAN)), F.array().cast(T.ArrayType(SPAN)))
        .alias("spans"),
    ).cast(FINDING)


def _findings(d: Definition, criteria: str = "criteria") -> list[Column]:
    def out(name: str) -> Column:
        return F.col(f"{criteria}.{name}")

    coded = F.col("coded_event")
    moved = (F.when(coded["reconciliation"] == "flagged_for_review",
                    f", with no mapping to {d.dictionary_target}; flagged, not recoded")
             .when(coded["reconciliation"] == "remapped_mechanically",
                   F.concat(F.lit(", renamed to "), coded["reconciled_to"])).otherwise(""))
    found = [_finding(
        "concept", F.lit(SATISFIED),
        F.concat(F.lit("code "), coded["code"], F.lit(" under "), coded["dictionary_version"],
                 F.lit(" belongs to "), coded["concept_id"], moved),
        assertion="present", availability="observed", value=coded["concept_id"], method="direct",
        source="structured_standard", source_variable="AEDECOD",
        spans=F.array(attrs.span(
            attrs.pointer("AE", F.col("source_record_id"), "AEDECOD"), F.lit(0),
            F.length(coded["code"]), F.lit("concept"),
            F.coalesce(coded["concept_id"], coded["code"]), coded["code"], "structured")))]
    for rule in d.modifiers:
        a = F.col("modifiers")[rule.name]
        reason = (
            F.when(a.isNull() | attrs.is_silent(a), F.concat_ws(
                " ", F.lit(f"{rule.name} is"), F.coalesce(a["availability"], F.lit("unresolved")),
                F.lit("- silence, not a negative:"), a["note"]))
            .when(~F.coalesce(a["method"].isin(*rule.accept_methods), F.lit(False)), F.concat(
                F.lit(f"{rule.name} was {{"), a["method"],
                F.lit(f"}}; {d.key} accepts {sorted(rule.accept_methods)}")))
            .when(out(rule.name) == SATISFIED, F.concat_ws(
                " ", F.lit(rule.name), attrs.route(a)))
            .when(attrs.from_text(a) & (a["confidence"] < d.min_confidence), F.format_string(
                f"{rule.name} was extracted at confidence %.2f, below {d.min_confidence:.2f}",
                a["confidence"]))
            .when(a["assertion"] == "uncertain", f"{rule.name}: the source hedges")
            .otherwise(F.concat_ws(" ", F.lit(f"{rule.name}:"), attrs.route(a))))
        found.append(_finding(rule.name, out(rule.name), reason, a))
    if d.temporal:
        a, w = F.col("exposure_relation"), d.temporal
        inside = F.when(out("temporal") == SATISFIED, "inside").otherwise("outside")
        reason = F.when(a["value"].isNull(), F.concat_ws(
            " ", F.lit(f"days since {w.anchor} are unknown:"), a["note"])).otherwise(
            F.concat(F.lit("onset "), a["value"].cast("string"), F.lit(f" days after {w.anchor}, "),
                     inside, F.lit(f" [{w.minimum}, {w.maximum}]")))
        found.append(_finding("temporal", out("temporal"), reason, a))
    if d.grade:
        a, name = _graded(d), d.grade.attribute
        reason = F.when(a["value"].isNull(), F.concat_ws(" ", F.lit(f"{name} is"),
                                                         a["availability"])).otherwise(
            F.concat(F.lit(f"{name} "), a["value"].cast("string"),
                     F.lit(f" against minimum {d.grade.minimum}")))
        found.append(_finding(name, out(name), reason, a))
    if d.dose:
        total = F.col("dose_days")
        shown = F.concat(total.cast("string"), F.lit(f" {d.dose.unit}"))
        label = F.concat(F.lit("doses before onset sum to "), shown)
        known = total.isNotNull()
        found.append(_finding(
            "cumulative_exposure", out("cumulative_exposure"),
            F.when(known, F.concat(label, F.lit(f", minimum {d.dose.minimum:g}"))).otherwise(
                "no exposure before onset could be summed"),
            assertion=F.when(known, "present"),
            availability=F.when(known, "observed").otherwise("unresolved"), value=total,
            method="derived", source="cross_domain", source_variable="EX",
            spans=F.when(known, F.array(attrs.span(
                F.concat(F.lit("EX:"), F.col("subject_id")), F.lit(0), F.lit(0),
                F.lit("cumulative_exposure"), shown, label, "derived")))))
    return found


def with_dose(scoped: DataFrame, d: Definition, ex: DataFrame | None) -> DataFrame:
    """Add ``dose_days`` where the definition sums doses; exposures are read only then."""
    if not d.dose:
        return scoped
    if ex is None:
        raise ValueError(f"{d.key} sums doses and needs the exposure rows")
    scoped = scoped.withColumn("onset_day", F.col("onset.value"))
    totals = dose_before(scoped.select("subject_id", F.col("onset_day").alias("onset")), ex)
    return scoped.join(
        totals.select("subject_id", F.col("onset").alias("onset_day"), "dose_days"),
        ["subject_id", "onset_day"], "left")


def judge(recs: DataFrame, d: Definition, maps: dict[str, str], *kept: Column | str) -> DataFrame:
    """The columns ``kept`` and a verdict per modifier map, named by ``maps``, whether in scope or not.

    The outcomes are one computed struct: later filters see a column, not the reading behind it.
    """
    judged = attrs.computed(recs, "judged", F.struct(*[outcomes(d, m).alias(name) for name, m in maps.items()]))
    return judged.select(*kept, *[decide(d, f"judged.{name}")[0].alias(name) for name in maps])


# -- the assignment --------------------------------------------------------------

def evaluate(recs: DataFrame, definition: Definition, config: TrialConfig,
             ex: DataFrame | None = None) -> DataFrame:
    """One assignment per in-scope record.

    Exposures are needed, and read, only when the definition sums doses.
    """
    d = definition
    scoped = with_dose(in_concept_set(recs, d, config), d, ex)
    # one computed struct: later filters see a column, not the reading behind it
    judged = attrs.computed(scoped, "criteria", outcomes(d))
    verdict, deciding = decide(d)
    findings = F.array(*_findings(d))
    out = judged.withColumns({"verdict": verdict, "deciding_criterion": deciding})
    out = out.withColumn("findings", findings)
    reason = _reason(d, F.col("findings"), F.col("deciding_criterion"))

    def routes(field: str) -> Column:
        # later findings of one name never occur, so names are unique map keys
        kept = F.filter("findings", lambda f: f[field].isNotNull())
        return F.map_from_entries(F.transform(kept, lambda f: F.struct(f["name"], f[field])))
    return out.select(
        "record_id", "subject_id", "study_id", "profile", "source_record_id", "verdict",
        "deciding_criterion", reason.alias("reason"), "findings",
        F.flatten(F.transform("findings", lambda f: f["spans"])).alias("evidence_spans"),
        routes("source_variable").alias("attribute_sources"),
        routes("method").alias("attribute_methods"),
        F.lit(d.id).alias("definition_id"), F.lit(d.version).alias("definition_version"),
        F.lit(d.content_hash).alias("definition_hash"))


def _reason(d: Definition, findings: Column, deciding: Column) -> Column:
    """Why: the reason of the deciding finding, or that every criterion holds."""
    why = F.get(F.filter(findings, lambda f: f["name"] == deciding), 0)
    return F.coalesce(why["reason"], F.lit(f"every criterion holds: {', '.join(d.criteria)}"))


def judge_both(recs: DataFrame, a: Definition, b: Definition, config: TrialConfig,
               ex: DataFrame | None = None) -> DataFrame:
    """Two definitions over one pass of the records, side by side in one row.

    Verdict, deciding criterion and reason carry the suffix ``_a`` or ``_b`` and are
    null where a definition has the record out of scope. Nothing is joined.
    """
    scopes = {s: [c for c in config.expand(d.include) if c not in d.exclude]
              for s, d in (("a", a), ("b", b))}
    rows = recs.filter(F.col("concept_id").isin(*sorted({*scopes["a"], *scopes["b"]})))
    rows = with_dose(rows, a if a.dose else b, ex)
    rows = attrs.computed(rows, "criteria", F.struct(outcomes(a).alias("a"), outcomes(b).alias("b")))
    columns = []
    for s, d in (("a", a), ("b", b)):
        inside = F.col("concept_id").isin(*scopes[s])
        verdict, deciding = decide(d, f"criteria.{s}")
        reason = _reason(d, F.array(*_findings(d, f"criteria.{s}")), deciding)
        columns += [F.when(inside, verdict).alias(f"verdict_{s}"),
                    F.when(inside, deciding).alias(f"deciding_{s}"),
                    F.when(inside, reason).alias(f"reason_{s}")]
    return rows.select("record_id", "subject_id", "study_id", *columns)


def cases(assignments: DataFrame) -> DataFrame:
    return assignments.filter("verdict = 'case'")


def ascertained(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("verdict").isin("case", "non_case"))


def used_text(methods: Column) -> Column:
    return F.array_contains(F.map_values(methods), "extracted")


def text_dependent_cases(assignments: DataFrame) -> DataFrame:
    """Cases that rest on prose."""
    return cases(assignments).filter(used_text(F.col("attribute_methods")))


def cases_by_subject(assignments: DataFrame) -> DataFrame:
    """Case counts per subject with the range of record ids; members stay one row each."""
    return cases(assignments).groupBy("study_id", "subject_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.min("record_id").alias("first_record"),
        F.max("record_id").alias("last_record"))
