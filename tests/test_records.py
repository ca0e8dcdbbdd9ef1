"""Structured reading: cells, codes, homes, dates, provenance."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import attrs, stats, values
from cohortloom.operators import normalize
from cohortloom.plans.trial import Trial

MODIFIER = "mucosal_involvement"


def column(spark, cells, fn):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("c"))).collect()]


def test_cells(spark):
    assert column(spark, ["Grade 2", "SEVERE ", "4", None], lambda c: values.enum_value(
        c, "severity")) == ["moderate", "severe", None, None]
    assert column(spark, ["drug-withdrawn", "None", "dose_not_changed", "stopped"],
                  lambda c: values.enum_value(c, "action")) == [
        "drug_withdrawn", "dose_not_changed", "dose_not_changed", None]
    assert column(spark, ["recovered with sequelae", "Ongoing"],
                  lambda c: values.enum_value(c, "outcome")) == [
        "recovered_with_sequelae", "not_recovered"]
    assert column(spark, ["Y", " no", "UNK", "2", ""], values.three_state) == [
        "present", "absent", "uncertain", None, None]
    assert column(spark, ["y", "0", "u"], values.yes_no) == [True, False, None]
    assert column(spark, ["3", " 2.9 ", "-1.5", "x", "nan"], values.whole_number) == [
        3, 2, -1, None, None]


def test_two_date_readers(spark):
    cells = ["2022-03-04", "2022-3-4", "04-Mar-2022", "04-MAR-2022", "04/03/2022",
             "2022-03-04T10:20", "2022-03-04T10:20:30", "04/Mar/2022", "NA", "2022-02-30",
             "2022-03", "2022-03-04T25:00"]
    day = dt.date(2022, 3, 4)
    assert column(spark, cells, values.record_date) == [day] * 7 + [None] * 5
    assert column(spark, cells, values.exposure_date) == [
        day, day, day, day, None, day, day, day, None, None, None, None]
    assert column(spark, ["2022", "2022-03", "2022-03-0"], values.is_partial_date) == [
        True, True, False]


def test_half_even_rounding(spark):
    assert spark.range(1).select(stats.round4(F.lit(0.28125))).first()[0] == 0.2812


@pytest.mark.parametrize("code,version,outcome,target", [
    ("Rash erythematous", "D-19.0", "remapped_mechanically", "Erythematous rash"),
    ("Rash maculopapular", "D-19.0", "flagged_for_review", None),
    ("Something nobody declared", "D-19.0", "flagged_for_review", None),
    ("Rash", "D-19.0", "unchanged", "Rash"),
    ("rash", "D-19.0", "remapped_mechanically", "Rash"),
    ("Rash erythematous", "D-21.0", "unchanged", "Rash erythematous")])
def test_reconciliation(read, code, version, outcome, target):
    coded = read([{"STUDYID": "STUDY-A", "AESPID": "R1", "AEDECOD": code,
                   "AEDICTVER": version}])["R1"]["coded_event"]
    assert (coded["code"], coded["reconciliation"], coded["reconciled_to"]) == (
        code, outcome, target)


def test_blank_code_and_fallback_version(read):
    recs = read([{"STUDYID": "STUDY-A", "AESPID": "R1", "AEDECOD": " "},
                 {"STUDYID": "STUDY-F", "AESPID": "R2", "AEDICTVER": None}])
    assert recs["R1"]["coded_event"] is None and recs["R1"]["concept_id"] is None
    assert recs["R2"]["coded_event"]["dictionary_version"] == "D-19.0"


def test_five_homes(read):
    sc = [{"IDVARVAL": "F1", "SCTESTCD": "MUCOSAL", "SCORRES": "N"},
          {"IDVARVAL": "F1", "SCTESTCD": "OTHER", "SCORRES": "Y"}]
    docs = [{"doc_id": "G1-CO", "study_id": "STUDY-G", "subject_id": "S1",
             "source_record_id": "G1", "text": "possible stomatitis"}]
    recs = read([{"STUDYID": "STUDY-A", "AESPID": "A1", "AEMUCOS": "Y"},
                 {"STUDYID": "STUDY-A", "AESPID": "A2"},
                 {"STUDYID": "STUDY-B", "AESPID": "B1", "AETERM": "rash with oral ulceration"},
                 {"STUDYID": "STUDY-C", "AESPID": "C1", "AETERM": "rash with oral ulceration"},
                 {"STUDYID": "STUDY-D", "AESPID": "D1", "AETERM": "rash without oral ulcers"},
                 {"STUDYID": "STUDY-F", "AESPID": "F1"}, {"STUDYID": "STUDY-G", "AESPID": "G1"}],
                sc=sc, documents=docs)
    got = {k: (r["modifiers"][MODIFIER]["assertion"], r["modifiers"][MODIFIER]["availability"],
               r["modifiers"][MODIFIER]["source_variable"]) for k, r in recs.items()}
    assert got == {
        "A1": ("present", "observed", "AEMUCOS"), "A2": (None, "unresolved", "AEMUCOS"),
        "B1": ("present", "observed", "AETERM"), "C1": (None, "not_collected", None),
        "D1": ("absent", "observed", "AETERM"), "F1": ("absent", "observed", "SC.MUCOSAL"),
        "G1": ("uncertain", "observed", "CO.COVAL")}
    assert recs["F1"]["linked_form_ids"] == ["MUCOSAL", "OTHER"]


def test_silence_follows_the_profile(read):
    recs = read([{"STUDYID": "STUDY-A", "AESPID": "R1", "AESEV": "", "AESTDTC": "2022-01",
                  "AEGRADE": "high", "AESER": "U"}])["R1"]
    assert recs["severity"]["availability"] == "unresolved" and recs["severity"]["note"] == ""
    assert "partial date" in recs["onset"]["note"]
    assert recs["exposure_relation"]["availability"] == "unresolved"
    assert "not a number" in recs["grade"]["note"]
    assert recs["seriousness"]["availability"] == "unresolved"


def test_seriousness_gate(read):
    recs = read([{"STUDYID": "STUDY-A", "AESPID": "R1", "AESER": "N", "AESCAT": "death"},
                 {"STUDYID": "STUDY-A", "AESPID": "R2", "AESER": "Y",
                  "AESCAT": "hospitalisation | disability"},
                 {"STUDYID": "STUDY-A", "AESPID": "R3", "AESER": None}])
    assert {a["availability"] for a in recs["R1"]["seriousness_criteria"].values()} == {
        "not_applicable"}
    said = {c for c, a in recs["R2"]["seriousness_criteria"].items() if a["assertion"] == "present"}
    assert said == {"hospitalisation", "disability"}
    assert {a["availability"] for a in recs["R3"]["seriousness_criteria"].values()} == {"unresolved"}


def test_undeclared_study_is_listed(mini, config):
    snap = mini([{"STUDYID": "STUDY-Z", "AESPID": "R1"}, {"STUDYID": "STUDY-A", "AESPID": "R2"}])
    assert [tuple(r) for r in normalize.undeclared_studies(snap.ae, config).collect()] == [
        ("STUDY-Z", 1)]
    assert Trial(snap).records.count() == 1


def test_audit_finds_broken_attributes(spark, mini, config):
    t = Trial(mini([{"STUDYID": "STUDY-A", "AESPID": "R1", "AEMUCOS": "Y"}]))
    sound = normalize.attribute_table(t.records, config)
    assert normalize.audit(sound).count() == 0
    bare = sound.withColumn("evidence", F.slice("evidence", 1, 0))
    broken = {(r["name"], r["rule"]) for r in normalize.audit(bare).collect()}
    assert ("grade", "observed_without_span") in broken
    mute = sound.withColumn("assertion", F.lit(None).cast("string"))
    assert {"observed_without_assertion"} <= {r["rule"] for r in normalize.audit(mute).collect()}


def test_config_is_checked(config):
    from cohortloom.config import ConfigError, TrialConfig
    with pytest.raises(ConfigError):
        config.expand(["NOBODY"], strict=True)
    with pytest.raises(ConfigError):
        config.surface_forms("unknown")
    bad = dict(config.profiles_raw, profiles={"P": {"modifier_homes": {MODIFIER: "attic"}}})
    with pytest.raises(ConfigError):
        TrialConfig(config.concepts_raw, config.extraction_raw, bad).places


def test_config_files(tmp_path, config):
    import json

    from cohortloom.config import TrialConfig
    paths = []
    for name, raw in (("c", config.concepts_raw), ("e", config.extraction_raw),
                      ("p", config.profiles_raw)):
        path = tmp_path / f"{name}.yaml"
        path.write_text(json.dumps(raw))  # JSON is YAML
        paths.append(path)
    again = TrialConfig.load(*paths)
    assert again.normalizer_version == config.normalizer_version
    assert again.extractor_version == config.extractor_version
    assert again.reading(()).extractor_version != config.extractor_version


def test_supportability(mini, config):
    t = Trial(mini([{"STUDYID": "STUDY-A", "AESPID": "R1"}]))
    status = {r["study_id"][-1]: r["status"] for r in t.supportability(MODIFIER).collect()}
    assert {s for s, v in status.items() if v == "supported"} == set("ADF")
    assert {s for s, v in status.items() if v == "supported_via_extraction"} == set("BEG")
    assert status["C"] == "cannot_ascertain"
    assert config.both_routes(MODIFIER) == ["P_both"]


def test_spans_of_own_ids_are_never_dealt(mini, config):
    t = Trial(mini([{"STUDYID": "STUDY-A", "AESPID": "R1", "AESER": "Y", "AESCAT": "death"},
                    {"STUDYID": "STUDY-A", "AESPID": "R2", "AESTDTC": None}]))
    found = t.spans()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the one aggregate of the long way deals spans by what they hold
    assert "extracted_value" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)
    long = normalize.spans(normalize.attribute_table(t.records, config))
    assert found.exceptAll(long.select(*found.columns)).count() == 0 and found.count() == long.count()


def test_spans_of_shared_ids_are_counted_once(mini, config):
    # one id three times: a whole copy, and one row with another grade
    rows = [{"STUDYID": "STUDY-A", "AESPID": "R1", "AEGRADE": g} for g in ("2", "2", "3")]
    t = Trial(mini(rows + [{"STUDYID": "STUDY-A", "AESPID": "R2"}]))
    assert [r[0] for r in normalize.repeated(t.structured).collect()] == ["STUDY-A:R1"]
    found, long = t.spans(), normalize.spans(normalize.attribute_table(t.records, config))
    assert found.exceptAll(long.select(*found.columns)).count() == 0 and found.count() == long.count()
    grades = found.filter("record_id = 'STUDY-A:R1' and field = 'AEGRADE'")
    assert sorted(r["extracted_value"] for r in grades.collect()) == ["2", "3"]


def test_checked_attributes_carry_what_invariants_read(mini, config):
    rows = [{"STUDYID": "STUDY-A", "AESPID": "R1", "AEMUCOS": "Y"}, {"STUDYID": "STUDY-A", "AESPID": "R2", "AEGRADE": "x"},
            {"STUDYID": "STUDY-B", "AESPID": "R3", "AETERM": "rash with oral ulceration"}]
    t = Trial(mini(rows))
    narrow, full = t.records_carrying(attrs.CHECKED), t.records
    assert narrow.schema.simpleString() == full.schema.simpleString()
    fields = ["record_id", "name", "value", "assertion", "availability", "source", "method"]
    size = F.size("evidence").alias("n")
    some, all_ = (normalize.attribute_table(r, config) for r in (narrow, full))
    assert some.select(*fields, size).exceptAll(all_.select(*fields, size)).count() == 0
    assert all_.filter("note <> '' or versions['backend'] = 'rules'").count() > 0
    # neither notes nor anything of a span is built
    assert some.filter("note is not null or versions is not null").count() == 0
    assert some.select(F.explode("evidence").alias("s")).filter("s.text is not null or s.doc_id is not null").count() == 0
    assert attrs.carried("note")


def test_broken_rules_are_listed_for_broken_attributes_only(mini):
    t = Trial(mini([{"STUDYID": "STUDY-A", "AESPID": "R1"}]))
    damaged = t.attribute_fields(*attrs.CHECKED).withColumn(
        "method", F.when(F.col("name") == "grade", "derived").otherwise(F.col("method")))
    broken = attrs.broken(damaged)
    assert [(r["name"], r["rule"]) for r in broken.collect()] == [("grade", "derived_outside_cross_domain")]
    plan = broken._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = next(i for i, line in enumerate(plan) if "Generate explode(rules" in line)
    assert any("Filter" in line for line in plan[above + 1:above + 4])
