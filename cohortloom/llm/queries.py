"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bbit_minhash, filter_diagrams, hilbert, license_join, line_runs, merkle_witness,
               mixture_packing, packed_ids, subword_classifier,
               suffix_rules, surrogates, tree_extract, wu_manber)
from .common import reachable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to packed files in doc_id order, and what the files give back."""
    manifest = packed_ids.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"),
                                packed_ids.new_folder(spark))
    return packed_ids.read_digests(manifest)


@query
def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_rules.repetition(table(spark, sf_dir, "documents"))


@query
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along a Hilbert curve over source, language and length."""
    placed = hilbert.shards(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"], 40, "rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = subword_classifier.fit(documents, table(spark, sf_dir, "labels"))
    scored = subword_classifier.score(documents, model)
    return scored.select("doc_id", subword_classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.contamination(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = mixture_packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return mixture_packing.pieces(packed, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


@query
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced under one key."""
    return surrogates.replace(table(spark, sf_dir, "documents"), key="op9")


@query
def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents")).drop("matches")


@query
def op12_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_diagrams.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_merkle_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with one in seven changed when its witness is followed."""
    def changed(id_col: str) -> Column:
        return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0
    found = merkle_witness.manifest(table(spark, sf_dir, "documents"), changed)
    return found.drop("lang", "proof")
