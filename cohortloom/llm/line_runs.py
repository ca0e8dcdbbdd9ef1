"""Lines that many documents share, found with levelled sorted runs of line hashes.

Documents arrive in batches. A batch becomes a run: its line hashes, sorted and bucketed by
hash, with the documents that hold each. Runs of a level are merged into one run of the
next level when there are ``fanout`` of them, so a hash is rewritten a logarithmic number
of times. Lines are judged by a merge join with the runs. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import blank_free, lower_ascii

#: Batches that a whole table is added in, and runs of a level before they are merged.
BATCHES, FANOUT = 4, 2


def line_key(line: Column) -> Column:
    """What makes lines equal: margins stripped, A-Z lowered."""
    return lower_ascii(blank_free(line))


def hashes(key: Column) -> list[Column]:
    """128 bits of a key, as two columns."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, mark (hash of the text), i (line number), h1, h2 of every line whose key has
    ``least`` code points or more."""
    split = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(
        i.alias("i"), line_key(line).alias("key")))
    line = F.explode(F.filter(split, lambda x: F.length(x["key"]) >= least)).alias("line")
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), line).select(
        "doc_id", "mark", "line.i", *hashes(F.col("line.key")))


class LineRuns:
    """The runs: per hash the number of documents that hold it and the largest of their ids."""

    def __init__(self, spark: SparkSession, least: int = 20, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.levels: list[list[DataFrame]] = []

    def _store(self, rows: DataFrame, level: int) -> DataFrame:
        """A run as a table sorted by hash; pre-aggregated, so a common line is one row a task."""
        merged = rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"),
                                              F.max("last_doc").alias("last_doc"))
        return written(merged.sortWithinPartitions("h1", "h2"), f"line-run-{level}")

    def add(self, held: DataFrame) -> None:
        """Add the ``lines`` of a batch; a document's lines must all be in one batch."""
        # rows that share an id, or lack one, are one document
        once = held.select("doc_id", "h1", "h2").distinct()
        run = once.select("h1", "h2", F.lit(1).cast("bigint").alias("n_docs"),
                          F.col("doc_id").alias("last_doc"))
        level = 0
        run = self._store(run, level)
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._store(reduce(DataFrame.unionByName, self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def common(self, documents: int) -> DataFrame:
        """Hashes that at least so many documents hold, over all runs."""
        parts = self.runs()
        whole = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(
            "h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return whole.filter(F.col("n_docs") >= documents)

    def unseen(self, held: DataFrame) -> DataFrame:
        """The lines of a new batch that no run holds: a merge anti-join with each run."""
        for run in self.runs():
            held = held.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return held

    def surplus(self, held: DataFrame, documents: int) -> DataFrame:
        """The lines an anti-join with the runs' common hashes would not leave: held by
        ``documents`` documents or more, in another than the largest id."""
        common = self.common(documents).select("h1", "h2", "last_doc").hint("merge")
        kept_in = F.col("doc_id").eqNullSafe(F.col("last_doc"))
        return held.join(common, ["h1", "h2"]).filter(~kept_in)


def dedup(docs: DataFrame, least: int = 20, documents: int = 3, id_col: str = "doc_id",
          text_col: str = "text", keep: list[str] | None = None, batches: int = BATCHES,
          fanout: int = FANOUT) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped per row, and the columns in ``keep``.

    A line whose key has ``least`` code points or more and is held by ``documents``
    documents or more stays only in the largest id that holds it. Order and repeats of the
    other lines stay. Null or empty text: one empty line. Rows with equal ids, and rows
    without an id, count as one document; an id beats no id. Empty tables give no rows.
    ``keep`` names further columns to carry; the rest are not read.
    """
    own = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"), own.alias("own"))
    held = written(lines(slim, least), "line-hashes")
    runs = LineRuns(docs.sparkSession, least, fanout)
    for k in range(batches):  # every document falls in one batch, whole
        runs.add(held.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    # the line numbers a document loses: never more than it has lines
    lost = runs.surplus(held, documents).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set("i")).alias("out")).withColumnsRenamed(
        {"doc_id": "lost_id", "mark": "lost_mark"})
    met = slim.withColumn("mark", F.xxhash64("text")).join(
        lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("mark") == F.col("lost_mark")), "left")
    split = F.split("text", "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), F.col("out"), F.array(F.size(split)))
    # what lies between the lost lines, in order: one slice each
    rest = F.flatten(F.transform(
        F.arrays_zip(F.slice("edges", F.lit(1), F.size("edges") - 1).alias("a"),
                     F.slice("edges", F.lit(2), F.size("edges") - 1).alias("b")),
        lambda x: F.slice("split", x["a"] + 2, x["b"] - x["a"] - 1)))
    parted = met.select("doc_id", "text", "own", "out", F.when(F.col("out").isNotNull(), edges).alias("edges"),
                        F.when(F.col("out").isNotNull(), split).alias("split"),
                        F.size(split).cast("bigint").alias("n_lines"))
    done = parted.select(
        "doc_id", F.when(F.col("out").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"),
        "n_lines", F.coalesce(F.size("out"), F.lit(0)).cast("bigint").alias("n_dropped"), "own")
    return done.select("doc_id", "text", "n_lines", "n_dropped", *[f"own.{c}" for c in keep or []])
