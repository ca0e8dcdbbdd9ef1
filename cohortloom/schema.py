"""Declared schemas: the input tables and the nested record contract."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, STRING) for n in names])


# Domain tables are read as text; numeric readings are added beside the raw cell.
DM = strings("STUDYID", "USUBJID", "AGE", "SEX", "ARM", "RFSTDTC", "COUNTRY", "PROFILE",
             "SYNTHETIC")
AE = strings("STUDYID", "USUBJID", "AESEQ", "AESPID", "AETERM", "AEDECOD", "AEDICTVER",
             "AEMUCOS", "AESEV", "AEGRADE", "AESER", "AESCAT", "AEREL", "AEACN", "AEOUT",
             "AESTDTC", "AEENDTC", "SYNTHETIC")
EX = strings("STUDYID", "USUBJID", "EXSEQ", "EXTRT", "EXDOSE", "EXDOSU", "EXSTDTC", "EXENDTC",
             "SYNTHETIC")
SC = strings("STUDYID", "USUBJID", "IDVAR", "IDVARVAL", "SCTESTCD", "SCTEST", "SCORRES",
             "SYNTHETIC")
CO = strings("STUDYID", "USUBJID", "IDVAR", "IDVARVAL", "COSEQ", "COVAL", "DOCID", "SYNTHETIC")
TABLES = {"dm": DM, "ae": AE, "ex": EX, "sc": SC, "co": CO}
REQUIRED_TABLES = ("dm", "ae")
DOCUMENTS = strings("doc_id", "study_id", "subject_id", "source_record_id", "kind", "header",
                    "text")

GOLD = T.StructType(
    [T.StructField(n, STRING) for n in (
        "source_record_id", "subject_id", "study_id", "profile", "truth_id", "cohort", "concept",
        "true_assertion", "true_value", "true_availability", "structured_assertion",
        "term_assertion", "comment_assertion", "text_assertion", "text_value", "true_verdict",
        "verdict_stage_structured", "verdict_stage_reported_term", "verdict_stage_comments",
        "verdict_if_readable")]
    + [T.StructField(n, T.BooleanType()) for n in (
        "in_structured", "in_reported_term", "in_comment", "in_text", "readable", "text_only")]
    + [T.StructField("onset_offset_days", T.IntegerType())]
)

SPAN = T.StructType([
    T.StructField("doc_id", STRING), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("field", STRING),
    T.StructField("extracted_value", STRING), T.StructField("text", STRING),
    T.StructField("kind", STRING),
])


def attribute(value: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("value", value), T.StructField("assertion", STRING),
        T.StructField("availability", STRING), T.StructField("source", STRING),
        T.StructField("source_variable", STRING), T.StructField("method", STRING),
        T.StructField("evidence", T.ArrayType(SPAN)),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("versions", T.MapType(STRING, STRING)),
        T.StructField("note", STRING), T.StructField("prior_availability", STRING),
    ])


FINDING = T.StructType([
    T.StructField("name", STRING), T.StructField("satisfied", T.BooleanType()),
    T.StructField("verdict", STRING), T.StructField("assertion", STRING),
    T.StructField("availability", STRING), T.StructField("value", STRING),
    T.StructField("method", STRING), T.StructField("source", STRING),
    T.StructField("source_variable", STRING), T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", STRING), T.StructField("spans", T.ArrayType(SPAN)),
])

# One row per text hit; offsets are code points into the text that was read.
MENTION = ("struct<start:int,end:int,hit_start:int,hit_end:int,value:string,assertion:string,"
           "confidence:double,rule:string,cue:string,anchor:string,surface:string>")

SCALAR_ATTRIBUTES = {
    "reported_term": STRING, "onset": T.DateType(), "end": T.DateType(),
    "exposure_relation": T.IntegerType(), "severity": STRING, "grade": T.IntegerType(),
    "seriousness": T.BooleanType(), "relatedness": STRING, "action": STRING, "outcome": STRING,
}

MANIFEST = T.StructType([
    T.StructField("manifest_id", STRING), T.StructField("created_at", STRING),
    T.StructField("actor", STRING), T.StructField("question", STRING),
    T.StructField("specification", STRING), T.StructField("definition_id", STRING),
    T.StructField("definition_version", T.IntegerType()),
    T.StructField("definition_hash", STRING), T.StructField("definition_status", STRING),
    T.StructField("study_scope", T.ArrayType(STRING)),
    T.StructField("n_subjects", T.LongType()), T.StructField("n_records", T.LongType()),
    T.StructField("data_snapshot_id", STRING),
    T.StructField("dictionary_versions", T.MapType(STRING, STRING)),
    T.StructField("normalizer_version", STRING), T.StructField("extractor_version", STRING),
    T.StructField("backend", STRING), T.StructField("output_pointer", STRING),
    T.StructField("results_hash", STRING),
    T.StructField("counts_by_verdict", T.MapType(STRING, T.LongType())),
    T.StructField("denominators", STRING),
    T.StructField("attribute_sources", T.MapType(STRING, T.LongType())),
    T.StructField("attribute_methods", T.MapType(STRING, T.LongType())),
    T.StructField("deterministic", T.BooleanType()),
    T.StructField("limitations", T.ArrayType(STRING)),
])
