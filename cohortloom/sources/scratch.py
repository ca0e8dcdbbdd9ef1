"""Intermediate tables: lineage is cut by writing to the folder the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster session names no shared folder for intermediate tables."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="cohortloom-")


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already, and its folder with it
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once, with Parquet options if given, and read back: several passes share one computation.

    The table is on shared storage: losing executors costs a re-read, not a re-run. It goes
    when the session's process ends.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, target)
    df.write.options(**options).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


# -- what a session makes once ------------------------------------------------------------

T = TypeVar("T")
#: Values that a session keeps: plans and readers of written tables, never rows.
KEPT = 64
_MADE: OrderedDict[tuple, object] = OrderedDict()


def stamp(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Name, length and change time of every file behind the paths: equal stamps, equal inputs."""
    found = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # of a folder, or of the one file
        for status in system.listStatus(path) if system.exists(path) else []:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, name: str, paths: Sequence[str], make: Callable[[], T]) -> T:
    """``make()`` for these inputs, made the first time in this session and kept for later calls.

    A changed, added or removed input file makes it anew.
    """
    key = (spark.sparkContext.applicationId, id(spark), name, stamp(spark, paths))
    if key not in _MADE:
        _MADE[key] = make()
        while len(_MADE) > KEPT:
            _MADE.popitem(last=False)
    _MADE.move_to_end(key)
    return _MADE[key]
