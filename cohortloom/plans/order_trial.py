"""Clinical tables derived from order tables, for the registered queries.

Customers are subjects, orders are exposures and line items are event rows, so work grows
with the tables. Keys and arithmetic decide everything, what a text says included, so the
same rows can be restated in plain SQL. Some texts say something else than the truth behind
them (``w`` against ``t``): studies that hold a modifier twice then disagree with themselves,
and some studies report what was not there.

No sentence is listed here. Events, modifiers, cues and phrases that assert nothing are taken
from the configured lexicons by key arithmetic, so every entry of them is written and read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..sources.snapshot import Snapshot, document_defaults

COMMENT_HEADER = "--- derived from order rows, for tests only ---"
CONCEPT_BY_KEY = ("RASH", "RASH", "RASH", "RASH_ERYTHEMATOUS", "RASH_MACULOPAPULAR", "PRURITUS",
                  "NAUSEA", "NEUTROPENIA")
CODE_BY_KEY = ("Rash", "Rash", "Rash", "Rash erythematous", "Rash maculopapular", "Pruritus",
               "Nausea", "Neutropenia")
PROFILE_BY_STUDY = ("P_structured", "P_text", "P_absent", "P_both", "P_negated", "P_version",
                    "P_concept_variant")
VERSION_BY_STUDY = ("D-21.0", "D-20.0", "D-21.0", "D-21.0", "D-21.0", "D-19.0", "D-21.0")


def pick(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options) + 1).cast("int"))


#: Catalogue values a site may name, and the cues around a modifier by what they make of it.
FORMS = {value: tuple(body["surface_forms"]) for value, body in
         fixed.CONCEPTS["modifiers"]["mucosal_involvement"]["values"].items()}
SITES = tuple(FORMS)
CUES = {name: (tuple(c.strip() for c in sides["pre"]), tuple(sides["post"]))
        for name, sides in fixed.EXTRACTION["assertion"]["cues"].items()}
ASSERTS_NOTHING = tuple(fixed.EXTRACTION["assertion"]["pseudo_cues"])
#: How many remarks that assert nothing precede the finding: a few, in every 19th comment many.
LONG_COMMENT = 40


def lexicon(concept: str) -> tuple[str, ...]:
    return tuple(fixed.CONCEPTS["concepts"][concept]["lexicon"])


def by_key(key: Column, names: tuple[str, ...], choice) -> Column:
    """``choice(name)`` for the name that the key selects."""
    out = choice(names[-1])
    for i, name in enumerate(names[:-1]):
        out = F.when(key % len(names) == i, choice(name)).otherwise(out)
    return out


def cued(assertion: str, modifier: Column, key: Column) -> Column:
    """The modifier behind or before one of the cues that give it this assertion."""
    before, after = CUES[assertion]
    place, cue = key % (len(before) + len(after)), pick(before + after, key)
    return F.when(place < len(before), F.concat(cue, F.lit(" "), modifier)).otherwise(
        F.concat(modifier, F.lit(" "), cue))


def dated(number: Column, text: Column) -> Column:
    return F.concat(F.lit("Day "), (number % 240).cast("string"), F.lit(": "), text, F.lit("."))


def day(offset: Column) -> Column:
    return F.date_add(F.lit("2022-01-01").cast("date"), offset.cast("int"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys and quantities behind every event: all the joins of the mapping, few columns."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
        F.min("l_quantity").alias("q"))
    first = orders.groupBy("o_custkey").agg(F.min(F.col("o_orderkey") % 200).alias("first_day"))
    own = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(own, "l_orderkey").join(first, "o_custkey")


def _events(base: DataFrame) -> DataFrame:
    """One row per event, with every derived ingredient still typed; no join."""
    pk, sk = F.col("pk"), F.col("sk")
    step = base.withColumns({
        "study": (F.col("o_custkey") % 7).cast("int"),
        "t": ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int"),
        "record": F.concat_ws("-", F.lit("R"), "l_orderkey", "l_linenumber"),
        "subject": F.concat(F.lit("C-"), F.col("o_custkey").cast("string")),
        "concept": pick(CONCEPT_BY_KEY, pk % 8),
        "event": by_key(pk, CONCEPT_BY_KEY, lambda concept: pick(lexicon(concept), sk)),
        "site": pick(SITES, pk),
        "onset_day": pk % 240,
    })
    # what is written, against what is true
    step = step.withColumn("w", F.when((F.col("study") == 3) & (F.col("t") == 0) & (sk % 13 == 0), 1)
                           .when((F.col("study") == 4) & (F.col("t") == 1) & (sk % 17 == 0), 0)
                           .otherwise(F.col("t")))
    t, w = F.col("t"), F.col("w")
    row, seen = F.floor(pk / len(SITES)), F.col("onset_day")
    phrase = (F.when(w == 1, pick(FORMS["UNSPECIFIED"], pk))
              .when(w == 4, F.concat(F.lit("site wording "), (pk % 97).cast("string")))
              .when(w != 3, by_key(pk, SITES, lambda site: pick(FORMS[site], row))))
    # words between event and modifier that say nothing, or a day
    linked = F.concat_ws(" ", "event", pick(fixed.LINK_WORDS[-3:], sk), pick(fixed.LINK_WORDS[:-3], pk), phrase)
    on_day = F.concat(F.col("event"), F.lit(" on day "), seen.cast("string"), F.lit(": "))
    absent, unsure = cued("absent", phrase, pk + sk), cued("uncertain", phrase, pk + sk)
    term = (F.when(w.isin(0, 4), F.when(sk % 3 == 1, F.concat(on_day, phrase)).otherwise(linked))
            .when(w == 1, F.concat(on_day, absent)).when(w == 2, F.concat(on_day, unsure)))
    finding = (F.when(w.isin(0, 4), F.concat(phrase, F.lit(" at "), (1 + sk % 4).cast("string"), F.lit(" places")))
               .when((w == 1) & (sk % 2 == 0), absent).when(w == 2, unsure))
    n_idle = F.when(sk % 19 == 0, LONG_COMMENT).otherwise(1 + sk % 3).cast("int")
    idle = F.transform(F.sequence(F.lit(1), n_idle), lambda i: dated(pk + i, pick(ASSERTS_NOTHING, pk + i)))
    remark = F.when(w != 3, F.concat_ws(" ", idle, dated(seen, finding)))
    study = F.col("study")
    in_term = ((study == 1) & t.isin(0, 2, 4)) | (study.isin(3, 4) & (t != 3))
    return step.withColumns({
        "study_id": F.concat(F.lit("STUDY-"), F.substring(F.lit("ABCDEFG"), study + 1, F.lit(1))),
        "profile": pick(PROFILE_BY_STUDY, study),
        "version": pick(VERSION_BY_STUDY, study),
        "code": F.when((pk % 8 == 3) & ~study.isin(1, 5), "Erythematous rash")
        .otherwise(pick(CODE_BY_KEY, pk % 8)),
        "phrase": phrase, "in_term": in_term,
        "aeterm": F.when(in_term, term).otherwise(F.col("event")),
        "comment": F.when((study == 6) & (t != 3), remark),
        "answer": F.when(t.isin(0, 4), "Y").when(t == 1, "N").when(t == 2, "U"),
        "onset_true": day(F.col("onset_day")),
        "offset_true": (F.col("onset_day") - F.col("first_day")).cast("int"),
        "grade": (1 + F.col("q").cast("int") % 4).cast("int"),
        "in_structured": study.isin(0, 3, 5) & (t != 3),
        "in_comment": (study == 6) & (t != 3),
    })


def _written(date: Column, dmy: Column) -> Column:
    return F.when(dmy, F.date_format(date, "dd-MMM-yyyy")).otherwise(date.cast("string"))


def snapshot(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> Snapshot:
    """The clinical snapshot behind one directory of order tables.

    ``keys`` is ``base`` written before, for jobs that need several of the tables.
    """
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = table("orders").select("o_orderkey", "o_custkey")
    events = _events(base(spark, sf_dir) if keys is None else keys)
    flag = F.lit("Y").alias("SYNTHETIC")
    pk, sk, key = F.col("pk"), F.col("sk"), F.col("o_orderkey")
    dmy = F.col("study") == 5

    def study_of(column: str) -> Column:
        return F.concat(F.lit("STUDY-"),
                        F.substring(F.lit("ABCDEFG"), (F.col(column) % 7 + 1).cast("int"), F.lit(1)))

    nation = table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    dm = table("customer").join(F.broadcast(nation), "c_nationkey", "left").select(
        study_of("c_custkey").alias("STUDYID"),
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("USUBJID"),
        (21 + F.col("c_custkey") % 62).cast("string").alias("AGE"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("SEX"),
        F.col("c_mktsegment").alias("ARM"), F.lit(None).cast("string").alias("RFSTDTC"),
        F.col("n_name").alias("COUNTRY"),
        pick(PROFILE_BY_STUDY, F.col("c_custkey") % 7).alias("PROFILE"), flag)

    ex = orders.select(
        study_of("o_custkey").alias("STUDYID"),
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("USUBJID"),
        key.cast("string").alias("EXSEQ"), F.lit("STUDY DRUG").alias("EXTRT"),
        F.when(key % 41 != 0, pick(("10", "20", "50"), key)).alias("EXDOSE"),
        F.lit("mg").alias("EXDOSU"),
        day(key % 200).cast("string").alias("EXSTDTC"),
        F.when(key % 10 != 0, day(key % 200 + 27).cast("string")).alias("EXENDTC"), flag)

    ae = events.select(
        F.col("study_id").alias("STUDYID"), F.col("subject").alias("USUBJID"),
        F.col("l_linenumber").cast("string").alias("AESEQ"), F.col("record").alias("AESPID"),
        F.col("aeterm").alias("AETERM"), F.col("code").alias("AEDECOD"),
        F.col("version").alias("AEDICTVER"),
        F.when(F.col("study").isin(0, 3), F.col("answer")).alias("AEMUCOS"),
        F.when(sk % 31 != 0, pick(("mild", "Moderate", "grade 3"), F.col("grade") - 1))
        .alias("AESEV"),
        F.col("grade").cast("string").alias("AEGRADE"),
        F.when(pk % 7 == 0, "Y").otherwise("N").alias("AESER"),
        F.when(pk % 7 == 0, pick(("hospitalisation", "other_medically_important",
                                  "hospitalisation | disability"), sk)).alias("AESCAT"),
        pick(("not related", "unlikely", "possible", "Possibly related", "probable",
              "no idea"), sk).alias("AEREL"),
        pick(("none", "dose reduced", "drug-interrupted", "drug withdrawn", "unknown"), pk)
        .alias("AEACN"),
        pick(("recovered", "resolved", "recovering", "ongoing", "not-recovered"), pk).alias("AEOUT"),
        F.when(sk % 23 == 0, None)
        .when(sk % 29 == 0, F.date_format("onset_true", "yyyy-MM"))
        .otherwise(_written(F.col("onset_true"), dmy)).alias("AESTDTC"),
        F.when(pk % 11 != 0, _written(day(F.col("onset_day") + 2 + pk % 27), dmy))
        .alias("AEENDTC"), flag)

    sc = events.filter(dmy & (F.col("t") != 3)).select(
        F.col("study_id").alias("STUDYID"), F.col("subject").alias("USUBJID"),
        F.lit("AESPID").alias("IDVAR"), F.col("record").alias("IDVARVAL"),
        F.lit("MUCOSAL").alias("SCTESTCD"), F.lit("Mucosal involvement").alias("SCTEST"),
        F.col("answer").alias("SCORRES"), flag)

    remarks = events.filter(F.col("in_comment"))
    co = remarks.select(
        F.col("study_id").alias("STUDYID"), F.col("subject").alias("USUBJID"),
        F.lit("AESPID").alias("IDVAR"), F.col("record").alias("IDVARVAL"),
        F.lit("1").alias("COSEQ"), F.col("comment").alias("COVAL"),
        F.concat("record", F.lit("-CO")).alias("DOCID"), flag)
    documents = document_defaults(remarks.select(
        F.concat("record", F.lit("-CO")).alias("doc_id"), "study_id",
        F.col("subject").alias("subject_id"), F.col("record").alias("source_record_id"),
        F.lit("comment").alias("kind"), F.lit(COMMENT_HEADER).alias("header"),
        F.col("comment").alias("text")))

    return Snapshot(dm=dm, ae=ae, ex=ex, sc=sc, co=co, documents=documents,
                    gold_rows=_gold(events), truth_rows=_truths(events))


def _verdict(readable: Column) -> Column:
    """Answer-key rule: scope and window are settled before readability."""
    t = F.col("t")
    return (F.when(~F.col("concept").startswith("RASH"), "non_case")
            .when(~F.col("offset_true").between(0, 30), "non_case")
            .when(~readable, "not_ascertainable")
            .when(t.isin(0, 4), "case").when(t == 1, "non_case").otherwise("review"))


def _truth_id() -> Column:
    return F.concat_ws("-", F.lit("T"), "concept", "t", "offset_true")


def _gold(events: DataFrame) -> DataFrame:
    t, study = F.col("t"), F.col("study")
    said = F.when(t.isin(0, 4), "present").when(t == 1, "absent").when(t == 2, "uncertain")
    structured, term, comment = F.col("in_structured"), F.col("in_term"), F.col("in_comment")
    text = term | comment
    readable = structured | text
    named = F.when(t.isin(0, 2) & (F.col("site") != "UNSPECIFIED"), F.col("site"))
    return events.select(
        F.col("record").alias("source_record_id"), F.col("subject").alias("subject_id"),
        "study_id", "profile", _truth_id().alias("truth_id"),
        F.when(F.col("l_linenumber") <= 4, "shared").otherwise("extra").alias("cohort"), "concept",
        said.alias("true_assertion"), named.alias("true_value"),
        F.when(readable, "observed").when(study == 2, "not_collected").otherwise("unresolved")
        .alias("true_availability"),
        F.when(structured, said).alias("structured_assertion"),
        F.when(term, said).alias("term_assertion"),
        F.when(comment, said).alias("comment_assertion"),
        F.when(text, said).alias("text_assertion"), F.when(text, named).alias("text_value"),
        _verdict(readable).alias("true_verdict"),
        _verdict(structured).alias("verdict_stage_structured"),
        _verdict(structured | term).alias("verdict_stage_reported_term"),
        _verdict(readable).alias("verdict_stage_comments"),
        _verdict(F.lit(True)).alias("verdict_if_readable"),
        structured.alias("in_structured"), term.alias("in_reported_term"),
        comment.alias("in_comment"), text.alias("in_text"), readable.alias("readable"),
        (text & ~structured).alias("text_only"), F.col("offset_true").alias("onset_offset_days"))


def _truths(events: DataFrame) -> DataFrame:
    """One row per truth: how many event rows write it down, and in which studies."""
    return events.groupBy(_truth_id().alias("truth_id"), "concept",
                          F.col("offset_true").alias("onset_offset_days")).agg(
        F.count(F.lit(1)).alias("n_renderings"),
        F.array_join(F.array_sort(F.collect_set("study_id")), ",").alias("rendered_in"))
