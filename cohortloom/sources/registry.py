"""Where results live, and the append-only register of runs that points at them."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MANIFEST
from .snapshot import _first_existing


class RunNotFound(RuntimeError):
    """A run or its results are not where the register says."""


def write_results(assignments: DataFrame, directory: str, manifest_id: str) -> str:
    """Write one run's assignments to its own partition; writing again replaces it."""
    target = f"{directory}/manifest_id={manifest_id}"
    assignments.write.mode("overwrite").parquet(target)
    return target


def read_results(spark: SparkSession, directory: str, manifest_id: str) -> DataFrame:
    target = f"{directory}/manifest_id={manifest_id}"
    if _first_existing(spark, target) is None:
        raise RunNotFound(f"no results at {target}; the register holds pointers, not copies")
    return spark.read.parquet(target)


def save_manifest(spark: SparkSession, directory: str, manifest: dict) -> None:
    """One JSON line per run in a file of its own, so runs never rewrite each other."""
    row = spark.createDataFrame([{f.name: manifest.get(f.name) for f in MANIFEST.fields}],
                                MANIFEST)
    row.coalesce(1).write.mode("overwrite").json(
        f"{directory}/manifest_id={manifest['manifest_id']}")


backfill = save_manifest


def manifests(spark: SparkSession, directory: str) -> DataFrame:
    """Every readable run; lines that are not manifests are skipped."""
    if _first_existing(spark, directory) is None:
        return spark.createDataFrame([], MANIFEST)
    fields = MANIFEST.fieldNames()
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MANIFEST.fields)
    raw = (spark.read.option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("recursiveFileLookup", True)
           .schema(declared + ", _corrupt_record string").json(directory))
    return raw.filter("_corrupt_record is null and manifest_id is not null "
                      "and definition_id is not null").select(*fields)


def load_manifest(spark: SparkSession, directory: str, manifest_id: str) -> dict:
    row = manifests(spark, directory).filter(F.col("manifest_id") == manifest_id).first()
    if row is None:
        raise RunNotFound(f"no run {manifest_id!r} in {directory}")
    return row.asDict(recursive=True)


def find(runs: DataFrame, definition_id: str | None = None, snapshot_id: str | None = None,
         actor: str | None = None) -> DataFrame:
    for column, wanted in (("definition_id", definition_id), ("data_snapshot_id", snapshot_id),
                           ("actor", actor)):
        if wanted:
            runs = runs.filter(F.col(column) == wanted)
    return runs


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    """The latest runs by creation time and id."""
    return runs.orderBy(F.desc("created_at"), F.desc("manifest_id")).limit(n)


def status(runs: DataFrame) -> DataFrame:
    """What the register holds; an empty one is the expected start, not a fault."""
    used = F.concat("definition_id", F.lit(".v"), F.col("definition_version").cast("string"))
    counted = runs.agg(F.count(F.lit(1)).alias("manifests"),
                       F.array_sort(F.collect_set(used)).alias("definitions_used"),
                       F.array_sort(F.collect_set("data_snapshot_id")).alias("snapshots"))
    return counted.withColumn("note", F.when(
        F.col("manifests") == 0, "nothing has been run yet").otherwise(
        F.format_string("%d run(s) recorded; earlier work only where backfilled",
                        F.col("manifests"))))


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def as_json(rows: DataFrame) -> str:
    """A few summary rows as JSON text."""
    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], sort_keys=True)
