"""A training corpus from raw documents: five stages, each a job of its own over all rows.

Every stage reads what its predecessor wrote and keeps the columns of ``documents``; the
last returns the pieces of the packed sequences with their ids. ``run`` chains them. The
result depends on tokenizer ids, so no SQL restates it; the tests hold it against a
brute-force version of every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bbit_minhash, line_runs, mixture_packing, suffix_rules, wu_manber
from cohortloom.llm.common import reachable, table
from cohortloom.llm.queries import vocabulary
from cohortloom.sources.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; too short or repetitive ones go."""
    return suffix_rules.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay only in the one with the largest id."""
    found = line_runs.dedup(docs, keep=["lang", "source"])
    return found.select("doc_id", "text", "lang", "source",
                        F.length("text").cast("bigint").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near-duplicates."""
    return bbit_minhash.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return wu_manber.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids with every source at its share, as one row a piece."""
    packed = mixture_packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return mixture_packing.pieces(packed)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reachable(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(quality_rules)),
    ("line_dedup", _stage(line_dedup)),
    ("near_dedup", _stage(near_dedup)),
    ("decontaminate", _stage(decontaminate)),
    ("pack", _stage(pack)),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
