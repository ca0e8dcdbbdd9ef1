"""Event rows, read through their study's profile, as provenance-carrying records.

``link`` does the joins while rows are narrow; ``records`` builds the nested
record from the linked row. A query that needs three attributes pays for three:
Catalyst prunes the rest.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..config import CELL, NOWHERE, PROSE, TrialConfig, dimension
from ..functions import attrs, values
from ..schema import SCALAR_ATTRIBUTES, SPAN, attribute
from ..sources.scratch import written
from ..sources.snapshot import Snapshot
from . import anchors

NO_TEXT, DOCUMENT_IDS, ANSWERS = "none", "ids", "answers"
RECORD_KEYS = ("record_id", "study_id", "profile", "source_record_id")


# -- joins ------------------------------------------------------------------

def undeclared_studies(ae: DataFrame, config: TrialConfig) -> DataFrame:
    """Event rows whose study declares no profile; a non-empty result is an error."""
    known = dimension(config.profile_dimension(ae.sparkSession).select(
        F.col("study_id").alias("STUDYID")), len(config.profiles))
    return ae.join(known, "STUDYID", "left_anti").groupBy(
        F.col("STUDYID").alias("study_id")).agg(F.count(F.lit(1)).alias("n_rows"))


def with_profile(ae: DataFrame, config: TrialConfig) -> DataFrame:
    profiles = config.profile_dimension(ae.sparkSession).withColumnRenamed("study_id", "STUDYID")
    return ae.join(dimension(profiles, len(config.profiles)), "STUDYID")


def with_coding(ae: DataFrame, config: TrialConfig) -> DataFrame:
    """Add ``coded_event``: concept by code and version, reconciled to the target version.

    A code unknown under its own version falls back to the first declared concept
    using that code anywhere. The recorded code is never rewritten.
    """
    codes = config.code_dimension(ae.sparkSession)
    size = sum(len(c["codes"]) for c in config.concepts.values())
    exact = codes.groupBy("code_key", "version").agg(
        F.max_by(F.struct("concept_id", "target_code"), "position").alias("exact"))
    loose = codes.groupBy("code_key").agg(
        F.min_by(F.struct("concept_id", "target_code"), "position").alias("loose"))
    code = F.when(~values.is_blank(F.col("AEDECOD")), values.strip(F.col("AEDECOD")))
    keyed = ae.withColumns({
        "code": code, "code_key": F.lower(code),
        "version": F.coalesce(F.nullif(F.col("AEDICTVER"), F.lit("")), F.col("profile_version"),
                              F.lit("")),
    })
    found = (keyed.join(dimension(exact, size), ["code_key", "version"], "left")
             .join(dimension(loose, size), "code_key", "left")
             .withColumn("match", F.coalesce("exact", "loose")))
    target = F.lit(config.target_version)
    concept, mapped = F.col("match.concept_id"), F.col("match.target_code")
    at_target = F.col("version") == target
    outcome = (F.when(concept.isNull(), "flagged_for_review").when(at_target, "unchanged")
               .when(mapped.isNull(), "flagged_for_review")
               .when(mapped == F.col("code"), "unchanged").otherwise("remapped_mechanically"))
    kept = (F.when(concept.isNull(), None).when(at_target, F.col("code")).otherwise(mapped))
    note = (F.when(concept.isNull(), F.concat_ws(" ", F.lit("no concept uses this code under"),
                                                 "version"))
            .when(at_target, "recorded under the target version")
            .when(mapped.isNull(), F.concat(concept, F.lit(" has no code under "), target))
            .when(mapped == F.col("code"), F.concat(F.lit("same code under "), target))
            .otherwise(F.concat(F.lit("renamed under "), target)))
    coded = F.when(F.col("code").isNotNull(), F.struct(
        F.col("code").alias("code"),
        F.coalesce(F.nullif(F.col("dictionary"), F.lit("")), F.lit(config.dictionary))
        .alias("dictionary"),
        F.col("version").alias("dictionary_version"), concept.alias("concept_id"),
        kept.alias("reconciled_to"), target.alias("reconciled_version"),
        outcome.alias("reconciliation"), note.alias("note")))
    return found.withColumn("coded_event", coded).drop(
        "code_key", "exact", "loose", "match", "code", "version")


def effective_code(coded: Column) -> Column:
    return F.coalesce(coded["reconciled_to"], coded["code"])


def linked_findings(sc: DataFrame, config: TrialConfig) -> DataFrame:
    """Per event row: the first result of each test a profile reads, and all test codes.

    First is by ``SRC_ORDER`` when the source carries one, else by the smallest
    result. One grouped pass with map-side combine; nothing grows with the group
    but the set of distinct test codes.
    """
    tests = sorted({p.variable.split(".", 1)[-1] for p in config.places if p.kind == "linked_form"})
    order = F.col("SRC_ORDER") if "SRC_ORDER" in sc.columns else F.col("SCORRES")
    firsts = [F.min_by(F.when(F.col("SCTESTCD") == t, F.struct("SCORRES")),
                       F.when(F.col("SCTESTCD") == t, F.struct(order.alias("o")))
                       ).alias(f"SC_{i}") for i, t in enumerate(tests)]
    return sc.groupBy(F.col("IDVARVAL").alias("AESPID")).agg(
        F.array_sort(F.collect_set("SCTESTCD")).alias("linked_form_ids"),
        F.count(F.lit(1)).alias("n_linked_rows"), *firsts,
    ).select("AESPID", "linked_form_ids", "n_linked_rows",
             F.create_map(*[x for i, t in enumerate(tests)
                            for x in (F.lit(f"SC.{t}"), F.col(f"SC_{i}.SCORRES"))])
             .cast("map<string,string>").alias("findings")
             if tests else F.create_map().cast("map<string,string>").alias("findings"))


def link(snapshot: Snapshot, config: TrialConfig, text: str = NO_TEXT,
         anchor: str | None = None) -> DataFrame:
    """Event rows with everything a record is built from.

    Joins run on narrow rows: the subject's anchor, then findings and documents, which
    share the record key and so one shuffle, then the broadcast dimensions.
    """
    from . import extract

    # read every column of an event row once; profiles may name any of them
    rows = snapshot.ae.filter(F.col("STUDYID").isin(*sorted(p.study_id for p in config.profiles.values())))
    start = anchors.first_occurrence(snapshot.ex, config, anchor or config.default_anchor)
    rows = rows.join(start.withColumnRenamed("subject_id", "USUBJID"), "USUBJID", "left")
    rows = rows.join(linked_findings(snapshot.sc, config), "AESPID", "left")
    if text != NO_TEXT:
        answers = extract.comment_answers(snapshot.documents, config, read=text == ANSWERS)
        rows = rows.join(answers.withColumnRenamed("source_record_id", "AESPID"), "AESPID", "left")
    # what a study and a code declare is the same in many rows, so it is never shuffled with them
    return with_coding(with_profile(rows, config), config)


# -- attributes -------------------------------------------------------------

def _cell(rows: DataFrame, variable: str) -> Column:
    return F.col(variable) if variable in rows.columns else F.lit(None).cast("string")


def _read(rows: DataFrame, variable: str, kind: T.DataType, value: Column, note: Column,
          assertion: Column | str = "present", shown: Column | None = None) -> Column:
    """A structured variable: observed when readable, otherwise silent and why."""
    cell = _cell(rows, variable)
    blank = values.is_blank(cell)
    evidence = F.array(attrs.structured_span("AE", F.col("AESPID"), variable,
                                             cell if shown is None else shown))
    return (F.when(blank, attrs.silent(kind, values.silence(F.col("collects"), variable),
                                       variable, "structured_standard"))
            .when(value.isNull(), attrs.silent(kind, "unresolved", variable,
                                               "structured_standard", note))
            .otherwise(attrs.direct(kind, assertion, variable, evidence, value)))


def _outside(variable: str, cell: Column, what: str) -> Column:
    return F.concat(F.lit(f"{variable} holds '"), cell, F.lit(f"', which is not {what}"))


def _text(rows, variable):
    cell = _cell(rows, variable)
    return _read(rows, variable, T.StringType(), values.strip(cell), F.lit(""))


def _enum(rows, variable, codelist):
    cell = _cell(rows, variable)
    return _read(rows, variable, T.StringType(), values.enum_value(cell, codelist),
                 _outside(variable, cell, f"in the {codelist} codelist"))


def _grade(rows):
    cell = _cell(rows, "AEGRADE")
    number = values.whole_number(cell)
    return _read(rows, "AEGRADE", T.IntegerType(), number,
                 _outside("AEGRADE", cell, "a number"), shown=number)


def _yes_no(rows, variable):
    cell = _cell(rows, variable)
    answer = values.yes_no(cell)
    note = F.when(values.three_state(cell).isNotNull(), "").otherwise(
        _outside(variable, cell, "a yes/no/unknown answer"))
    return _read(rows, variable, T.BooleanType(), answer, note,
                 F.when(answer, "present").otherwise("absent"))


def _date(rows, variable):
    cell = _cell(rows, variable)
    note = F.when(values.is_partial_date(cell), _outside(
        variable, cell, "a full date; a partial date supports no day arithmetic")).otherwise(
        _outside(variable, cell, "a readable date"))
    return _read(rows, variable, T.DateType(), values.record_date(cell), note)


def _criteria(rows: DataFrame, config: TrialConfig) -> Column:
    """Seriousness criteria, gated on the seriousness answer."""
    gates = sorted({p.gate_variable for p in config.profiles.values()})
    cell = reduce(lambda acc, g: F.when(F.col("gate_variable") == g, _cell(rows, g)).otherwise(acc),
                  gates, F.lit(None).cast("string"))
    answer = F.when((cell.isNull()) | (cell == ""), None).otherwise(
        (F.size("gate_true") == 0) | F.array_contains("gate_true", cell))
    recorded = F.transform(F.split(F.coalesce(_cell(rows, "AESCAT"), F.lit("")), r"\|"),
                           values.strip)
    kind = T.BooleanType()

    def one(criterion: Column) -> Column:
        hit = F.array_contains(recorded, criterion)
        evidence = F.array(attrs.structured_span("AE", F.col("AESPID"), "AESCAT", F.coalesce(
            _cell(rows, "AESCAT"), F.lit(""))))
        closed = (~answer) & F.col("gate_false_means").isNotNull()
        return F.struct(criterion.alias("key"), (
            F.when(F.coalesce(closed, F.lit(False)), attrs.silent(
                kind, F.col("gate_false_means"), "AESCAT", "structured_standard",
                "not applicable: seriousness was answered no"))
            .when(answer.isNull(), attrs.silent(
                kind, values.silence(F.col("collects"), "AESER"), "AESCAT", "structured_standard",
                "seriousness itself is unanswered"))
            .otherwise(attrs.direct(kind, F.when(hit, "present").otherwise("absent"), "AESCAT",
                                    evidence, hit))).alias("value"))
    # one plain expression a criterion: the body of a transform is interpreted for every row
    return F.map_from_entries(F.array(*[one(F.lit(c)) for c in fixed.SERIOUSNESS_CRITERIA]))


def _placed(rows: DataFrame, where: str, variable: str) -> Column:
    """The cell that a declared place names."""
    return (F.try_element_at("findings", F.lit(variable)) if where == "linked_form"
            else _cell(rows, variable))


def _settled(rows: DataFrame, where: str, variable: str) -> Column:
    """The answer of a filled cell, or why it could not be read."""
    kind, cell = T.StringType(), _placed(rows, where, variable)
    state = values.three_state(cell)
    domain = "SC" if where == "linked_form" else "AE"
    evidence = F.array(attrs.structured_span(domain, F.col("AESPID"), variable, cell))
    unread = attrs.silent(kind, "unresolved", variable, where,
                          _outside(variable, cell, "a yes/no/unknown answer"))
    return F.when(state.isNull(), unread).otherwise(
        attrs.direct(kind, state, variable, evidence, source=where))


def _modifier(rows: DataFrame, config: TrialConfig, modifier: str) -> Column:
    """The first filled cell; else a placeholder for prose; else silence.

    Studies share few arrangements of places, and each arrangement is one plain branch.
    """
    kind = T.StringType()
    arrangements: dict[tuple, list[str]] = {}
    for profile in config.profiles:
        key = tuple((p.way, p.kind, p.variable) for p in config.places_of(modifier, profile=profile))
        arrangements.setdefault(key, []).append(profile)
    out = attrs.silent(kind, "not_collected", note=F.concat(
        F.col("profile"), F.lit(f" has no place for {modifier}")))
    for key, profiles in arrangements.items():
        if all(way == NOWHERE for way, _, _ in key):
            continue
        prose = [(k, v) for way, k, v in key if way == PROSE]
        if prose:
            where, variable = prose[0]
            read = attrs.silent(kind, "unresolved", variable, where, F.concat(
                F.col("profile"), F.lit(f" leaves {modifier} to the text of {variable}")))
        else:
            _, where, variable = key[0]
            read = attrs.silent(kind, values.silence(F.col("collects"), variable or modifier),
                                variable, where, f"nothing in {variable}")
        for way, where, variable in reversed(key):
            if way == CELL:
                read = F.when(values.is_blank(_placed(rows, where, variable)), read).otherwise(
                    _settled(rows, where, variable))
        out = F.when(F.col("profile").isin(*sorted(profiles)), read).otherwise(out)
    return out


def _exposure_relation(onset: Column, anchor: str) -> Column:
    """Days from the anchor to onset; computed across domains, so marked derived."""
    kind = T.IntegerType()
    offset = F.datediff(onset["value"], F.col("anchor_date"))
    detail = F.concat(F.lit("onset "), onset["value"].cast("string"), F.lit(f" minus {anchor} "),
                      F.col("anchor_date").cast("string"), F.lit(" is "), offset.cast("string"),
                      F.lit(" days"))
    evidence = F.array(attrs.span(
        F.concat(F.lit("DERIVED:"), F.col("AESPID")), F.lit(0), F.length(detail),
        F.lit("exposure_relation"), detail, detail, "derived"))
    return (F.when(onset["value"].isNull(), attrs.silent(
                kind, "unresolved", "AE+EX",
                note=F.concat(F.lit("the onset date is "), onset["availability"])))
            .when(F.col("anchor_date").isNull(), attrs.silent(
                kind, "unresolved", "AE+EX", note=f"no {anchor} in the exposure rows"))
            .otherwise(attrs.build(kind, value=offset, assertion="present",
                                   source="cross_domain", variable="AE+EX", method="derived",
                                   evidence=evidence, note=detail)))


# -- records ----------------------------------------------------------------

def records(linked: DataFrame, config: TrialConfig, anchor: str | None = None) -> DataFrame:
    """One record per event row. Structured reading only; prose stays unread here."""
    onset = _date(linked, "AESTDTC")
    has_docs = "comment_doc_id" in linked.columns
    mods = config.modifiers
    modifiers = F.map_from_arrays(F.array(*[F.lit(m) for m in mods]),
                                  F.array(*[_modifier(linked, config, m) for m in mods]))
    first = linked.withColumn("onset", onset)
    return first.select(
        F.concat_ws(":", "STUDYID", "AESPID").alias("record_id"),
        F.col("STUDYID").alias("study_id"), F.col("USUBJID").alias("subject_id"),
        F.col("AESPID").alias("source_record_id"), F.lit("AE").alias("source_form_id"), "profile",
        "coded_event", F.col("coded_event.concept_id").alias("concept_id"),
        _text(linked, "AETERM").alias("reported_term"), modifiers.alias("modifiers"), "onset",
        _date(linked, "AEENDTC").alias("end"),
        _exposure_relation(F.col("onset"), anchor or config.default_anchor)
        .alias("exposure_relation"),
        _enum(linked, "AESEV", "severity").alias("severity"), _grade(linked).alias("grade"),
        _yes_no(linked, "AESER").alias("seriousness"),
        _criteria(linked, config).alias("seriousness_criteria"),
        _enum(linked, "AEREL", "relatedness").alias("relatedness"),
        _enum(linked, "AEACN", "action").alias("action"),
        _enum(linked, "AEOUT", "outcome").alias("outcome"),
        (F.col("comment_doc_id") if has_docs else F.lit(None).cast("string"))
        .alias("comment_doc_id"),
        F.coalesce("linked_form_ids", F.array().cast("array<string>")).alias("linked_form_ids"),
        F.lit(config.normalizer_version).alias("normalizer_version"),
        F.lit("").alias("extractor_version"),
        *([F.col("comments")] if "comments" in linked.columns else []),
    )


def attribute_lists(recs: DataFrame, config: TrialConfig, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per record with its ``attributes``, the value as text.

    ``fields`` names those of an attribute that are wanted, all unless given: what a generator
    explodes is not pruned, so spans and notes nobody reads would be copied into every row.
    """
    kept = [f.name for f in attribute(T.StringType()).fields if fields is None or f.name in fields]

    def entry(name: Column, a: Column) -> Column:
        return F.struct(name.alias("name"), *[
            (a[f].cast("string") if f == "value" else a[f]).alias(f) for f in kept])
    scalars = [entry(F.lit(n), F.col(n)) for n in SCALAR_ATTRIBUTES]
    mods = [entry(F.lit(m), F.col("modifiers")[m]) for m in config.modifiers]
    criteria = [entry(F.lit(f"seriousness_criteria.{c}"), F.col("seriousness_criteria")[c])
                for c in fixed.SERIOUSNESS_CRITERIA]
    return recs.select(*RECORD_KEYS, F.array(*scalars, *mods, *criteria).alias("attributes"))


def attribute_table(recs: DataFrame, config: TrialConfig, fields: Sequence[str] | None = None) -> DataFrame:
    """Long form: one row per (record, attribute). ``fields`` as in ``attribute_lists``."""
    # built in a projection, which is compiled, and never empty: see ``attrs.computed``
    held = attribute_lists(recs, config, fields)
    return held.select(*RECORD_KEYS, F.explode_outer("attributes").alias("a")).select(*RECORD_KEYS, "a.*")


def repeated(recs: DataFrame) -> DataFrame:
    """Ids that several records share, written: few or none, where ids are keys."""
    return written(recs.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id"),
                   "repeated-records")


def spans(attributes: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Distinct evidence spans per record, out of the attribute table.

    With the ids that several records share (``repeated``), ``attributes`` are the lists of the
    records: a list of its own id is cleared of copies inside its row, and only the spans of
    shared ids are dealt by what they hold.
    """
    each = ["record_id", *attrs.SPAN_KEYS]
    if shared is None:
        return attributes.select("record_id", F.explode("evidence").alias("s")).select(
            "record_id", "s.*").dropDuplicates(each)
    none = F.array().cast(T.ArrayType(SPAN))

    def listed(lists: DataFrame) -> DataFrame:
        held = F.flatten(F.transform("attributes", lambda a: F.coalesce(a["evidence"], none)))
        keyed = F.transform(held, lambda s: F.struct(*[s[k].alias(k) for k in attrs.SPAN_KEYS]))
        # never null, and an empty list gives no row
        distinct = lists.select("record_id", F.array_distinct(keyed).alias("spans"))
        return distinct.select("record_id", F.explode_outer("spans").alias("s")).filter(
            "s is not null").select("record_id", "s.*")
    if shared.isEmpty():
        return listed(attributes)
    return listed(attributes.join(shared, "record_id", "left_anti")).unionByName(
        listed(attributes.join(shared, "record_id", "left_semi")).dropDuplicates(each))


def audit(attributes: DataFrame) -> DataFrame:
    """Attributes that break an invariant; sound data gives no rows."""
    return attrs.broken(attributes).select("record_id", "name", "rule")
