"""Filling open modifiers from prose.

Texts are read where they lie: reported terms inside the record row, comments in
the document row. Only the answers travel. A record with any number of documents
is reduced by ``min_by`` on the map side, never collected.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..config import TrialConfig
from ..functions import attrs
from ..functions.mentions import MentionReader
from ..schema import MENTION
from ..sources.scratch import written

BACKEND = "rules"
PROMPT_VERSION = "rules-1"
Reader = Callable[[DataFrame, str, str, list], DataFrame]


def readable_modifiers(config: TrialConfig) -> list[str]:
    """Modifiers some study's prose may be asked about."""
    return [m for m in config.extractable if config.askable_studies(m)]


def rules_reader(config: TrialConfig) -> Reader:
    """The built-in reader: adds ``said``, one answer struct per modifier.

    The answer is a computed column: the optimizer cannot copy the reading expression into
    later filters and projections.
    """
    reader = MentionReader(config)

    def read(df: DataFrame, text: str, kind: str, modifiers: list) -> DataFrame:
        said = [f"{reader.best(text, m, repr(kind))} AS `{m}`" for m in modifiers]
        return attrs.computed(df, "said", F.struct(*[F.expr(s) for s in said]))
    return read


def comment_answers(documents: DataFrame, config: TrialConfig, read: bool = True,
                    reader: Reader | None = None) -> DataFrame:
    """Per record: the first document, and per modifier the first document that answers.

    Only documents of studies whose prose may be asked are read.
    """
    modifiers = readable_modifiers(config) if "comment" in config.readable_sources else []
    first = documents.groupBy("source_record_id").agg(F.min("doc_id").alias("comment_doc_id"))
    if not read or not modifiers:
        return first
    studies = sorted({s for m in modifiers for s in config.askable_studies(m)})
    asked = documents.withColumn("readable_text", F.when(
        F.col("study_id").isin(*studies), F.col("full_text")))
    said = (reader or rules_reader(config))(
        asked.select("source_record_id", "doc_id", "readable_text"), "readable_text", "comment",
        modifiers)
    answers = []
    for m in modifiers:
        hit = F.when(F.col(f"said.{m}").isNotNull(),
                     F.struct("doc_id", F.col(f"said.{m}").alias("answer")))
        key = F.when(F.col(f"said.{m}").isNotNull(), F.col("doc_id"))
        answers.append(F.min_by(hit, key).alias(m))
    return said.groupBy("source_record_id").agg(
        F.min("doc_id").alias("comment_doc_id"),
        F.struct(F.count(F.lit(1)).alias("n_documents"), *answers).alias("comments"))


def askable(config: TrialConfig, modifier: str) -> Column:
    """Whether prose may be asked: open, kept in readable prose, never structured."""
    current = F.col("modifiers")[modifier]
    return (~current["availability"].isin(*fixed.SETTLED)
            & F.col("study_id").isin(*config.askable_studies(modifier))
            & ~F.coalesce(current["source"].isin(*fixed.STRUCTURED_SOURCES), F.lit(False)))


def _terms(recs: DataFrame, config: TrialConfig, reader: Reader | None) -> DataFrame:
    """Read the reported term of records that still ask."""
    modifiers = readable_modifiers(config)
    wanted = reduce(lambda a, b: a | b, [askable(config, m) for m in modifiers])
    text = F.when(wanted & attrs.observed(F.col("reported_term")), F.col("reported_term.value"))
    staged = recs.withColumn("term_text", text if "reported_term" in config.readable_sources
                             else F.lit(None).cast("string"))
    return (reader or rules_reader(config))(staged, "term_text", "reported_term", modifiers)


def read_prose(recs: DataFrame, config: TrialConfig, documents: DataFrame | None = None,
               reader: Reader | None = None) -> DataFrame:
    """Add what the prose says: ``said`` for the term and ``comments`` for documents.

    Records linked with comment answers carry them already; otherwise ``documents``
    are read and joined here.
    """
    if not readable_modifiers(config):
        return recs
    if "comments" not in recs.columns and documents is not None \
            and "comment" in config.readable_sources:
        answers = comment_answers(documents, config, reader=reader)
        recs = recs.drop("comment_doc_id").join(answers, "source_record_id", "left")
    return _terms(recs, config, reader)


def filled_modifiers(config: TrialConfig, has_comments: bool) -> Column:
    """The modifier map after reading: the first text that answers fills an open modifier.

    The term comes before comments. What the structured reading left stays in
    ``prior_availability``. ``config`` decides which sources count, so one reading
    can serve several restrictions.
    """
    modifiers = readable_modifiers(config)
    use_comments = has_comments and "comment" in config.readable_sources
    use_term = "reported_term" in config.readable_sources
    versions = F.create_map(*[F.lit(x) for x in (
        "extractor", config.extractor_version, "prompt", PROMPT_VERSION, "backend", BACKEND)])

    def answered(m: str, answer: Column, doc: Column, source: str, variable: str,
                 prior: Column) -> Column:
        evidence = F.array(attrs.span(
            doc, answer["start"], answer["end"], F.lit(m),
            F.coalesce(answer["value"], answer["assertion"]), answer["surface"], "text"))
        note = F.concat(F.lit("'"), answer["surface"], F.lit("': "), answer["rule"])
        return attrs.build(
            T.StringType(), value=answer["value"], assertion=answer["assertion"], source=source,
            variable=variable, method="extracted", evidence=evidence,
            confidence=answer["confidence"], versions=versions, note=note, prior=prior)

    columns = []
    for m in config.modifiers:
        current = F.col("modifiers")[m]
        if m not in modifiers:
            columns.append(current)
            continue
        open_ = askable(config, m)
        chain, tries = F.when(F.lit(False), current), F.lit(0)
        if use_term:
            term = F.col(f"said.{m}")
            chain = chain.when(open_ & term.isNotNull(), answered(
                m, term, attrs.pointer("AE", F.col("source_record_id"), "AETERM"),
                "reported_term", "AETERM", current["availability"]))
            tries = F.when(F.col("term_text").isNotNull(), 1).otherwise(0)
        if use_comments:
            first = F.col(f"comments.{m}")
            chain = chain.when(open_ & first.isNotNull(), answered(
                m, first["answer"], first["doc_id"], "comment", "CO.COVAL",
                current["availability"]))
            tries = tries + F.coalesce("comments.n_documents", F.lit(0))
        noted = F.concat_ws("; ", F.nullif(current["note"], F.lit("")), F.concat(
            F.lit("prose was read "), tries.cast("int").cast("string"),
            F.lit(" time(s) and settled nothing")))
        if attrs.carried("note"):
            chain = chain.when(open_ & (tries > 0), current.withField("note", noted))
        columns.append(chain.otherwise(current))
    return F.map_from_arrays(F.array(*[F.lit(m) for m in config.modifiers]), F.array(*columns))


def enrich(recs: DataFrame, config: TrialConfig, documents: DataFrame | None = None,
           reader: Reader | None = None) -> DataFrame:
    """Records with open modifiers filled from prose. No coded field is touched."""
    stamped = recs.withColumn("extractor_version", F.lit(config.extractor_version))
    if not readable_modifiers(config):
        return stamped.drop("comments")
    read = read_prose(stamped, config, documents, reader)
    return read.withColumn("modifiers", filled_modifiers(config, "comments" in read.columns)).drop(
        "said", "term_text", "comments")


# -- what was asked, and what came back --------------------------------------

def attempts(recs: DataFrame, documents: DataFrame, config: TrialConfig,
             reader: Reader | None = None) -> DataFrame:
    """One row per (record, text, modifier) asked, with the answer's assertion.

    A text after the first answer for its modifier is not asked.
    """
    modifiers = readable_modifiers(config)
    readable = config.readable_sources
    staged = recs.drop("comments")
    terms = _terms(staged, config, reader).filter("term_text is not null") \
        if "reported_term" in readable else None

    def long(df: DataFrame, turn: int, doc: Column) -> DataFrame:
        return df.select("record_id", "study_id", F.struct(
            F.lit(turn).alias("turn"), doc.alias("doc")).alias("at"), F.explode(F.array(*[
                F.struct(F.lit(m).alias("modifier"), F.col(f"asks.{m}").alias("asks"),
                         F.col(f"said.{m}.assertion").alias("assertion"))
                for m in modifiers])).alias("x")).filter("x.asks").select(
            "record_id", "study_id", "at", "x.modifier", "x.assertion")

    asks = F.struct(*[askable(config, m).alias(m) for m in modifiers])
    parts = []
    if terms is not None:
        parts.append(long(terms.withColumn("asks", asks), 0, F.lit("")))
    if "comment" in readable:
        open_ = staged.select("record_id", "study_id", "source_record_id", asks.alias("asks")
                              ).filter(reduce(lambda a, b: a | b,
                                              [F.col(f"asks.{m}") for m in modifiers]))
        docs = (reader or rules_reader(config))(
            documents.filter(F.col("study_id").isin(*sorted(
                {s for m in modifiers for s in config.askable_studies(m)})))
            .select("source_record_id", "doc_id", "full_text"), "full_text", "comment", modifiers)
        parts.append(long(open_.join(docs, "source_record_id"), 1, F.col("doc_id")))
    # the readings are written once; the cut-off and the summaries below re-read them
    tried = written(reduce(DataFrame.unionByName, parts), "attempts")
    first = tried.filter("assertion is not null").groupBy("record_id", "modifier").agg(
        F.min("at").alias("first"))
    return tried.join(first, ["record_id", "modifier"], "left").filter(
        F.col("first").isNull() | (F.col("at") <= F.col("first"))).drop("first")


def attempt_summary(tried: DataFrame) -> DataFrame:
    """Requests, recoveries, abstentions and recoveries by assertion."""
    requests = tried.groupBy("record_id", "at").agg(F.lit(1).alias("one")).agg(
        F.count(F.lit(1)).alias("requests"))
    recovered = F.count("assertion")
    counts = tried.agg(
        recovered.alias("recovered"), (F.count(F.lit(1)) - recovered).alias("abstained"),
        *[F.count_if(F.coalesce(F.col("assertion") == a, F.lit(False))).alias(f"recovered_{a}")
          for a in fixed.ASSERTIONS])
    return requests.crossJoin(F.broadcast(counts)).withColumn(
        "abstention_rate", F.coalesce(F.try_divide(
            F.col("abstained").cast("double"),
            (F.col("recovered") + F.col("abstained")).cast("double")), F.lit(0.0)))


# -- corpus-wide mentions -----------------------------------------------------

def mention_table(recs: DataFrame, documents: DataFrame, config: TrialConfig,
                  modifier: str = "mucosal_involvement") -> DataFrame:
    """Every mention of a modifier in any readable text of any record."""
    reader = MentionReader(config)
    keys = ["study_id", "subject_id", "source_record_id", "profile"]
    parts = []
    if "reported_term" in config.readable_sources:
        parts.append(recs.filter(attrs.observed(F.col("reported_term"))).select(
            *keys, attrs.pointer("AE", F.col("source_record_id"), "AETERM").alias("doc_id"),
            F.col("reported_term.value").alias("sentence"),
            F.lit("reported_term").alias("source_kind"), F.lit("AETERM").alias("source_variable")))
    if "comment" in config.readable_sources:
        # only documents with a phrase hit meet the join
        hit = F.col("full_text").rlike(reader.any_form(modifier))
        docs = documents.filter(hit).select("source_record_id", "doc_id",
                                            F.col("full_text").alias("sentence"))
        parts.append(recs.select(*keys).join(docs, "source_record_id").select(
            *keys, "doc_id", "sentence", F.lit("comment").alias("source_kind"),
            F.lit("CO.COVAL").alias("source_variable")))
    texts = reduce(DataFrame.unionByName, parts)
    found = F.expr(reader.ordered("sentence", modifier, "source_kind"))
    return texts.withColumn("m", F.explode(found)).select(
        F.concat_ws(":", "doc_id", "m.start", "m.assertion").alias("mention_id"), "doc_id", *keys,
        F.lit(modifier).alias("modifier"), "m.assertion", "m.value", "m.surface", "sentence",
        "source_kind", "source_variable", "m.confidence", "m.rule", "m.start", "m.end")


# -- boundary audits ----------------------------------------------------------

def boundary_violations(recs: DataFrame, config: TrialConfig) -> DataFrame:
    """Open structured answers whose study also keeps the modifier in prose.

    A structured cell nobody could read must not be settled by prose; such records
    are listed here and never asked.
    """
    rows = []
    for m in readable_modifiers(config):
        current = F.col("modifiers")[m]
        rows.append(recs.filter(
            ~current["availability"].isin(*fixed.SETTLED)
            & F.col("study_id").isin(*config.askable_studies(m))
            & current["source"].isin(*fixed.STRUCTURED_SOURCES)
        ).select("record_id", F.lit(m).alias("modifier"),
                 current["source_variable"].alias("source_variable"),
                 F.lit("structured_source").alias("reason")))
    empty = recs.sparkSession.createDataFrame(
        [], "record_id string, modifier string, source_variable string, reason string")
    return reduce(DataFrame.unionByName, rows, empty)


def request_violations(requests: DataFrame, recs: DataFrame) -> DataFrame:
    """Requests (record_id, modifier, source_kind, mechanism) that may not be sent to a reader."""
    facts = recs.select("record_id", F.explode("modifiers").alias("modifier", "a")).select(
        "record_id", "modifier", F.col("a.availability").alias("availability"),
        F.col("a.source").alias("source"), F.lit(True).alias("known"))
    reason = (
        F.when(F.col("mechanism").isin("coded_concept_variation", "terminology_version_variation"),
               "deterministic_mechanism")
        .when(~F.col("mechanism").eqNullSafe(F.lit("language_variation")), "unknown_mechanism")
        .when(F.col("source_kind").isin(*fixed.STRUCTURED_SOURCES), "structured_text")
        .when(F.col("known").isNull(), "unknown_modifier")
        .when(F.col("availability").isin(*fixed.SETTLED), "settled")
        .when(F.col("source").isin(*fixed.STRUCTURED_SOURCES), "structured_source"))
    return requests.join(facts, ["record_id", "modifier"], "left").withColumn(
        "reason", reason).filter("reason is not null").select(*requests.columns, "reason")


CODED_FIELDS = ("code", "dictionary", "dictionary_version", "concept_id", "reconciled_to",
                "reconciliation")


def coded_changes(recs: DataFrame, config: TrialConfig, documents: DataFrame,
                  reader: Reader | None = None) -> DataFrame:
    """Coded fields that reading the prose of ``recs`` changes; a sound reader gives no rows.

    What a record was coded as rides along in its own row, so nothing is derived twice or joined.
    """
    read = enrich(recs.withColumn("coded_before", F.col("coded_event")), config, documents, reader)
    fields = F.array_compact(F.array(*[
        F.when(~F.col(f"coded_before.{f}").eqNullSafe(F.col(f"coded_event.{f}")), f) for f in CODED_FIELDS]))
    return read.select("record_id", F.explode(fields).alias("field"))


# -- answers produced elsewhere ------------------------------------------------

ANSWER_SCHEMA = "assertion string, value string, start string, end string, confidence string"


def validate_answers(answers: DataFrame, config: TrialConfig) -> DataFrame:
    """Check answers from an outside reader: accepted, abstained or discarded whole.

    ``answers`` has doc_id, text, modifier and ``payload``, a JSON object or null. An
    unknown assertion, a value outside the catalogue or a range outside the text
    discards the answer; nothing is rounded off to a near miss.
    """
    # form -> value is a configuration map: a literal, so nothing is joined
    forms = {f"{m}\x1f{form}": v for m in config.modifiers
             for form, v in config.surface_forms(m).items()}
    ids = {f"{m}\x1f{v}": v for m in config.modifiers for v in config.values_of(m)}

    def table(pairs: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

    body = F.from_json("payload", ANSWER_SCHEMA)
    raw = F.nullif(F.btrim(F.col("a.value")), F.lit(""))
    key = F.concat_ws("\x1f", "modifier", raw)
    folded = F.concat_ws("\x1f", "modifier", F.trim(
        F.regexp_replace(F.lower(raw), r"(?U)[\s-]+", " ")))
    value = F.when(raw.isNotNull(), F.coalesce(F.try_element_at(table(ids), key),
                                               F.try_element_at(table(forms), folded)))
    said = F.lower(F.btrim(F.col("a.assertion")))
    start, end = F.col("a.start").try_cast("int"), F.col("a.end").try_cast("int")
    in_text = (start >= 0) & (start < end) & (end <= F.length("text"))
    read = answers.withColumn("a", body).withColumns({
        "said": said, "named": value, "first": start, "last": end,
        "sound": F.coalesce(said.isin(*fixed.ASSERTIONS) & (raw.isNull() | value.isNotNull())
                            & in_text, F.lit(False))})
    outcome = (F.when(F.col("said").isNull() | (F.col("said") == ""), "abstained")
               .when(F.col("sound"), "accepted").otherwise("discarded"))
    kept = F.col("outcome") == "accepted"
    default = config.confidence("extraction_default")
    return read.withColumn("outcome", outcome).select(
        "doc_id", "modifier", "outcome", F.when(kept, F.col("said")).alias("assertion"),
        F.when(kept, F.col("named")).alias("value"), F.when(kept, F.col("first")).alias("start"),
        F.when(kept, F.col("last")).alias("end"),
        F.when(kept, F.coalesce(F.nullif(F.col("a.confidence").try_cast("double"), F.lit(0.0)),
                                F.lit(default))).alias("confidence"),
        F.when(kept, F.substring("text", F.col("first") + 1, F.col("last") - F.col("first")))
        .alias("surface"))


def model_reader(predict: Callable, config: TrialConfig) -> Reader:
    """Plug a vectorised model into ``enrich`` in place of the rules.

    ``predict(texts, kind, modifier)`` takes and returns pandas Series; each answer is a
    JSON object or None and is validated like any outside answer. Runs as an Arrow
    batch function, row in, row out.
    """
    def read(df: DataFrame, text: str, kind: str, modifiers: list) -> DataFrame:
        out = df
        for m in modifiers:
            def payload(texts, m=m):
                return predict(texts, kind, m)
            call = F.pandas_udf(payload, "string")
            out = out.withColumn(f"raw_{m}", call(F.col(text)))
        said = [_validated(F.col(f"raw_{m}"), F.col(text), m, config).alias(m) for m in modifiers]
        return attrs.computed(out, "said", F.struct(*said)).drop(*[f"raw_{m}" for m in modifiers])
    return read


def _validated(payload: Column, text: Column, modifier: str, config: TrialConfig) -> Column:
    """One validated answer in the shape the rules give, or null."""
    a = F.from_json(payload, ANSWER_SCHEMA)
    raw = F.nullif(F.btrim(a["value"]), F.lit(""))
    pairs = {**config.surface_forms(modifier), **{v: v for v in config.values_of(modifier)}}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    value = F.coalesce(F.try_element_at(table, raw), F.try_element_at(
        table, F.trim(F.regexp_replace(F.lower(raw), r"(?U)[\s-]+", " "))))
    said = F.lower(F.btrim(a["assertion"]))
    start, end = a["start"].try_cast("int"), a["end"].try_cast("int")
    sound = (said.isin(*fixed.ASSERTIONS) & (raw.isNull() | value.isNotNull())
             & (start >= 0) & (start < end) & (end <= F.length(text)))
    surface = F.substring(text, start + 1, end - start)
    confidence = F.coalesce(F.nullif(a["confidence"].try_cast("double"), F.lit(0.0)),
                            F.lit(config.confidence("extraction_default")))
    return F.when(F.coalesce(sound, F.lit(False)), F.struct(
        start.alias("start"), end.alias("end"), start.alias("hit_start"), end.alias("hit_end"),
        value.alias("value"), said.alias("assertion"), confidence.alias("confidence"),
        F.lit("outside reader, validated").alias("rule"), F.lit(None).cast("string").alias("cue"),
        F.lit(None).cast("string").alias("anchor"), surface.alias("surface"))).cast(MENTION)
