"""Reading modifiers out of prose."""

import json

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text
from cohortloom.functions.mentions import MentionReader
from cohortloom.operators import extract

MODIFIER = "mucosal_involvement"
TERMS = [
    ("rash with oral mucosal involvement", "present", "ORAL", 0.95),
    ("rash and mucosal erosions", "present", None, 0.95),
    ("rash, oral ulceration noted", "present", "ORAL", 0.78),
    ("rash without mucosal involvement", "absent", None, 0.9),
    ("rash, no mucosal involvement", "absent", None, 0.9),
    ("rash; mucosal involvement was absent", "absent", None, 0.9),
    ("rash, mucosal involvement was not present", "absent", None, 0.9),
    ("rash with possible mucosal involvement", "uncertain", None, 0.55),
    ("rash, query mucosal involvement", "uncertain", None, 0.55),
    ("rash; mucosal involvement cannot be excluded", "uncertain", None, 0.55),
    ("rash with oral ulceration. No dose change was made.", "present", "ORAL", 0.95),
    ("no rash, but oral ulceration was seen", "present", "ORAL", 0.78),
    ("rash with involvement of the wet surfaces", None, None, None),
    ("Mucosal involvement was absent.", None, None, None),
    ("rash with oral ulceration and rash with conjunctival involvement", None, None, None),
    ("Investigator comment: no mucosal involvement was seen at any visit.", None, None, None),
    ("rash with buccal erosions", "present", "ORAL", 0.95),
    ("eruption with stomatitis", "present", "ORAL", 0.95),
    # hyphens and runs of spaces inside a phrase, and case
    ("RASH with Oral-Mucosal   involvement", "present", "ORAL", 0.95),
    # a hedge outranks a negation governing the same mention
    ("possible rash, no oral ulceration", "uncertain", "ORAL", 0.55),
    # a terminator ends the reach of a cue
    ("rash without itching; oral ulceration", "present", "ORAL", 0.78),
    # a phrase that holds a cue word but asserts nothing
    ("no dose change for rash with oral ulceration", "present", "ORAL", 0.95),
    # more than twelve words between event and phrase
    ("rash " + "word " * 13 + "oral ulceration", None, None, None),
    # two sites under one cue disagree
    ("rash with no oral ulceration or conjunctivitis", None, None, None),
    # the event is in another sentence
    ("Rash on day 4. Oral ulceration followed.", None, None, None),
    ("", None, None, None),
]


@pytest.fixture(scope="module")
def best(spark, config):
    reader = MentionReader(config)
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TERMS)], "i int, txt string")
    said = rows.select("i", F.expr(reader.best("txt", MODIFIER, "'reported_term'")).alias("t"),
                       F.expr(reader.best("txt", MODIFIER, "'comment'")).alias("c"))
    return {r["i"]: (r["t"], r["c"]) for r in said.collect()}


@pytest.mark.parametrize("i", range(len(TERMS)))
def test_term(best, i):
    _, assertion, value, confidence = TERMS[i]
    got = best[i][0]
    if assertion is None:
        assert got is None
    else:
        assert (got["assertion"], got["value"], got["confidence"]) == (assertion, value, confidence)


def test_offsets_point_at_the_surface(best):
    for i, (txt, *_rest) in enumerate(TERMS):
        for got in best[i]:
            if got is not None:
                assert txt[got["start"]:got["end"]] == got["surface"]


def test_comment_needs_no_event(best):
    texts = [t[0] for t in TERMS]
    comment = best[texts.index(
        "Investigator comment: no mucosal involvement was seen at any visit.")][1]
    assert comment["assertion"] == "absent" and comment["surface"].startswith("no ")
    assert best[texts.index("Mucosal involvement was absent.")][1]["assertion"] == "absent"


def test_sentences(spark):
    rows = spark.createDataFrame([("HEAD x\nRash on day 4.  Oral ulceration followed? (Yes. no. \n "
                                   " Z. 3 ",), ("",), ("é. Über. A",)], "t string")
    got = [r[0] for r in rows.select(F.expr(text.sentences("t"))).collect()]
    assert [s["text"] for s in got[0]] == [
        "HEAD x", "Rash on day 4.", "Oral ulceration followed?", "(Yes. no.", "Z.", "3"]
    assert got[1] == []
    assert [(s["text"], s["s"], s["e"]) for s in got[2]] == [("é. Über.", 0, 8), ("A", 9, 10)]


def test_layers_are_prefix_free():
    layers = text.prefix_free(["no associated", "no evidence of", "no", "without"])
    assert layers == [["no", "without"], ["no associated", "no evidence of"]]


def test_surrounding_mention_keeps_the_longest(spark, config):
    reader = MentionReader(config)
    rows = spark.createDataFrame([("rash with oral mucosal involvement, no stomatitis",)], "t string")
    got = rows.select(F.expr(reader.ordered("t", MODIFIER, "'reported_term'"))).first()[0]
    assert [(m["surface"], m["assertion"]) for m in got] == [
        ("oral mucosal involvement", "present"), ("no stomatitis", "absent")]


def test_second_modifier_is_read_too(spark, config):
    reader = MentionReader(config)
    rows = spark.createDataFrame([("rash on sun exposed areas",)], "t string")
    got = rows.select(F.expr(reader.best("t", "photosensitivity", "'reported_term'"))).first()[0]
    assert (got["assertion"], got["value"]) == ("present", "PRESENT")


def test_fold(spark):
    rows = spark.createDataFrame([("Haemorrhage Hospitalisation oedema realised",)], "t string")
    assert rows.select(F.expr(text.fold("t"))).first()[0] == \
        "hemorrhage hospitalization edema realized"
    assert text.fold_constant("Oedema realising") == "edema realizing"


# -- records --------------------------------------------------------------------------

def test_first_text_to_answer_wins(read):
    docs = [{"doc_id": d, "study_id": "STUDY-G", "subject_id": "S1", "source_record_id": "R1",
             "text": t} for d, t in (
        ("D3", "oral ulceration seen"), ("D2", "no oral ulceration"), ("D1", "nothing to add"))]
    rec = read([{"STUDYID": "STUDY-G", "AESPID": "R1"}], documents=docs)["R1"]
    m = rec["modifiers"][MODIFIER]
    assert (m["assertion"], m["source_variable"], m["prior_availability"]) == (
        "absent", "CO.COVAL", "unresolved")
    assert m["evidence"][0]["doc_id"] == "D2" and rec["comment_doc_id"] == "D1"


def test_abstention_keeps_the_silence_and_says_so(read):
    docs = [{"doc_id": "D1", "study_id": "STUDY-G", "subject_id": "S1", "source_record_id": "R1",
             "text": "nothing to add"}]
    m = read([{"STUDYID": "STUDY-G", "AESPID": "R1"}],
             documents=docs)["R1"]["modifiers"][MODIFIER]
    assert m["availability"] == "unresolved" and m["assertion"] is None
    assert "read 2 time(s)" in m["note"]


def test_settled_value_is_never_asked(read):
    rec = read([{"STUDYID": "STUDY-D", "AESPID": "R1", "AEMUCOS": "N",
                 "AETERM": "rash with oral ulceration"}])["R1"]
    m = rec["modifiers"][MODIFIER]
    assert (m["assertion"], m["method"]) == ("absent", "direct")


def test_unreadable_structured_cell_goes_to_the_audit(spark, mini, config):
    from cohortloom.plans.trial import Trial
    t = Trial(mini([{"STUDYID": "STUDY-D", "AESPID": "R1", "AEMUCOS": "maybe",
                     "AETERM": "rash with oral ulceration"}]))
    listed = extract.boundary_violations(t.structured, config).collect()
    assert [(r["modifier"], r["reason"]) for r in listed] == [(MODIFIER, "structured_source")]
    m = t.records.first()["modifiers"][MODIFIER]
    assert m["availability"] == "unresolved" and m["source"] == "structured_standard"


ANSWER = {"assertion": "present", "value": "ORAL", "start": 10, "end": 25}


@pytest.mark.parametrize("change,outcome", [
    ({}, "accepted"), ({"assertion": "probably"}, "discarded"),
    ({"value": "SOMEWHERE"}, "discarded"), ({"value": None}, "accepted"),
    ({"value": "Oral-ulcers"}, "accepted"), ({"start": -1}, "discarded"),
    ({"end": 9999}, "discarded"), ({"start": 20, "end": 5}, "discarded"),
    ({"start": "x"}, "discarded"), ({"assertion": None}, "abstained")])
def test_outside_answers(spark, config, change, outcome):
    row = ("d", "rash with oral ulceration", MODIFIER, json.dumps({**ANSWER, **change}))
    got = extract.validate_answers(spark.createDataFrame(
        [row], "doc_id string, text string, modifier string, payload string"), config).first()
    assert got["outcome"] == outcome
    if outcome == "accepted":
        assert got["surface"] == "oral ulceration" and got["confidence"] == 0.8


def test_outside_reader_fills_modifiers(mini, config):
    import pandas as pd

    from cohortloom.plans.trial import Trial

    def predict(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps({**ANSWER, "end": len(t)}) if t else None)

    def call(texts, kind, modifier):
        return predict(texts)
    t = Trial(mini([{"STUDYID": "STUDY-B", "AESPID": "R1", "AETERM": "rash with oral ulceration"}]),
              reader=extract.model_reader(call, config))
    m = t.records.first()["modifiers"][MODIFIER]
    assert (m["assertion"], m["value"], m["confidence"]) == ("present", "ORAL", 0.8)


def test_restricting_sources(mini, config):
    from cohortloom.plans.trial import Trial
    rows = [{"STUDYID": "STUDY-B", "AESPID": "R1", "AETERM": "rash with oral ulceration"}]
    for sources, availability in (((), "unresolved"), (("comment",), "unresolved"),
                                  (("reported_term",), "observed")):
        t = Trial(mini(rows), config.reading(sources))
        assert t.records.first()["modifiers"][MODIFIER]["availability"] == availability
