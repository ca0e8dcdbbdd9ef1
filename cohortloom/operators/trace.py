"""From a reported number back to the text it rests on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

LEVELS = ("result", "analysis", "cohort", "definition", "attribute", "record", "span")
LINK = ["example", "level_order", "position", "level", "identifier", "detail"]


def trace_number(assignments: DataFrame, attributes: DataFrame, recs: DataFrame, manifest: dict,
                 label: str, number: int | None = None, verdict: str = "case", examples: int = 3,
                 spans_per_record: int = 6) -> DataFrame:
    """Links of the chain in reading order; a number that is not given is counted in the chain itself.

    Every assignment is judged once, into a narrow table that is written; the first
    ``examples`` of it are a top-n cut. What is shown of them is then read from their own
    rows: their ids are literals, which reach the sources, so no other record is built.
    """
    spark = assignments.sparkSession
    matching = assignments.filter(F.col("verdict") == verdict)
    order = ["study_id", "subject_id", "record_id"]
    judged = written(matching.select(*order, "source_record_id"), "trace-judged")
    few = judged.orderBy(*order).limit(examples).collect()
    head = spark.createDataFrame([
        (0, 1, 0, "analysis", manifest["manifest_id"],
         f"by {manifest['actor']}; normalizer {manifest['normalizer_version']}, extractor "
         f"{manifest['extractor_version']}, snapshot {manifest['data_snapshot_id']}"),
        (0, 3, 0, "definition",
         f"{manifest['definition_id']}.v{manifest['definition_version']}",
         f"status {manifest['definition_status']}, hash {manifest['definition_hash']}"),
    ], "example int, level_order int, position int, level string, identifier string, "
       "detail string")
    stated = F.col("n") if number is None else F.lit(number)
    cohort = judged.agg(
        F.array_join(F.array_sort(F.collect_set("study_id")), "|").alias("studies"),
        F.count(F.lit(1)).alias("n")).select(F.inline(F.array(
            _link(0, "result", F.lit(label), F.concat_ws(" = ", F.lit(label), stated.cast("string"))),
            _link(2, "cohort", F.when(F.col("studies") == "", "(empty)").otherwise(F.col("studies")),
                  F.concat_ws(" ", F.col("n").cast("string"), F.lit("record(s) with verdict"), F.lit(verdict))))))
    chosen = _only(matching, few).orderBy(*order).limit(examples)
    numbered = chosen.select(
        F.row_number().over(_by_record()).alias("example"), "record_id", "findings")
    findings = numbered.select("example", F.posexplode("findings").alias("position", "f")).filter(
        "f.satisfied").select(
        "example", F.lit(4).alias("level_order"), "position", F.lit("attribute").alias("level"),
        F.col("f.name").alias("identifier"), F.col("f.reason").alias("detail"))
    ids = F.broadcast(numbered.select("example", "record_id"))
    records = _only(recs, few).join(ids, "record_id").select(
        "example", F.lit(5).alias("level_order"), F.lit(0).alias("position"),
        F.lit("record").alias("level"), F.col("record_id").alias("identifier"),
        F.concat_ws(" ", "source_form_id", F.lit("row of"), "study_id", F.lit("read as"),
                    "profile", F.lit("by"), "normalizer_version").alias("detail"))
    spans = _only(attributes, few).join(ids, "record_id").select(
        "example", F.explode("evidence").alias("s")).groupBy("example").agg(F.slice(F.array_sort(
            F.collect_list(F.struct("s.field", "s.start", "s.end", "s.doc_id",
                                    "s.extracted_value"))), 1, spans_per_record).alias("s"))
    pointers = spans.select("example", F.posexplode("s").alias("position", "s")).select(
        "example", F.lit(6).alias("level_order"), "position", F.lit("span").alias("level"),
        F.format_string("%s:%d-%d", F.col("s.doc_id"), F.col("s.start"), F.col("s.end"))
        .alias("identifier"), F.concat_ws(" = ", "s.field", "s.extracted_value").alias("detail"))
    parts = [cohort, findings, records, pointers]
    chain = head
    for part in parts:
        chain = chain.unionByName(part)
    return chain.orderBy("example", "level_order", "position")


def _link(order: int, level: str, identifier: Column, detail: Column) -> Column:
    return F.struct(F.lit(0).alias("example"), F.lit(order).alias("level_order"), F.lit(0).alias("position"),
                    F.lit(level).alias("level"), identifier.alias("identifier"), detail.alias("detail"))


def _only(df: DataFrame, few: list) -> DataFrame:
    """The rows of a few records. The source id is asked for too: it is a join key below."""
    for key in ("record_id", "source_record_id"):
        if key in df.columns:
            df = df.filter(reduce(Column.__or__, [F.col(key).eqNullSafe(F.lit(v)) for v in sorted(
                {r[key] for r in few}, key=str)], F.lit(False)))
    return df


def _by_record():
    from pyspark.sql import Window
    # runs over the few chosen examples only
    return Window.partitionBy(F.lit(1)).orderBy("study_id", "subject_id", "record_id")


def broken_at(chain: DataFrame) -> str | None:
    """Where a chain breaks: no matching record, a record not found, or one without spans."""
    levels = {(r["example"], r["level"]) for r in chain.select("example", "level").distinct()
              .collect()}
    examples = {e for e, _ in levels if e}
    if not examples or any((e, "record") not in levels for e in examples):
        return "record"
    return "span" if any((e, "span") not in levels for e in examples) else None
