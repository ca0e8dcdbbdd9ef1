"""Packing of documents into training sequences under a source mixture.

Every source is a queue of its documents' tokens in id order, and deficit round-robin serves
the queues: each round adds to a source's credit its share of a window, whole tokens leave
up to that credit, and the rest of it is carried on. A source whose share of a window is
under ``LEAST`` tokens saves its credit for several rounds. With carried credit a token's
round follows from its place in its queue, so the service order needs only running totals:
one of the documents over each queue and, after a sort by (round, source, place), one of
the pieces over the stream that windows are cut from. Both are distributed sums over parts;
deficits thereby carry across windows and partitions exactly. While all queues last, a
window holds of each source its share, give or take the tokens of one turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import before, sorted_rows
from ..sources.scratch import written
from .common import steps
from .units import ENCODE_BYTES, encoder

WINDOW = 2048
#: Tokens that a source's turn has at least, so pieces are not cut to shreds for tiny sources.
LEAST = 16


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """row, doc_id, source, n_tokens and the ids in two or four bytes each; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        size = coder.kind.itemsize
        for batch in batches:
            for part in steps(batch, "text", ENCODE_BYTES):
                ids = coder.encode(part.column("text"), end_id)
                n_tokens = pc.divide(pc.binary_length(ids), size).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), n_tokens, ids],
                                                 names=["doc_id", "source", "n_tokens", "ids"])

    made = docs.mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def queue_totals(rows: DataFrame, order: list[str], value: str, name: str,
                 by: str | None = None) -> DataFrame:
    """``rows`` with ``reach``: the running total of ``value`` in ``order``, within ``by`` if given.

    ``order`` starts with ``by``. Sorted parts sum up their rows as they stream; what earlier
    parts hold is added from one row per part (and group).
    """
    laid = sorted_rows(rows, order, name)
    columns = laid.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, total = None, None, 0
        for batch in batches:
            values = batch.column(value).to_numpy()
            parts = batch.column("part").to_numpy()
            new = np.ones(len(values), dtype=bool)
            new[1:] = parts[1:] != parts[:-1]
            if by:
                names = batch.column(by).dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= names[1:] != names[:-1]
            if len(values):
                first = batch.column(by)[0].as_py() if by else None
                new[0] = parts[0] != part or first != group
                sums = np.cumsum(values)
                starts = np.flatnonzero(new)
                base = np.zeros(len(values), dtype=np.int64)
                run_of = np.cumsum(new) - 1
                offsets = sums[starts] - values[starts]
                base = np.where(run_of < 0, -total, offsets[np.maximum(run_of, 0)] if len(starts) else -total)
                reach = sums - base
                part, total = parts[-1], int(reach[-1])
                group = batch.column(by)[len(values) - 1].as_py() if by else None
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach)],
                                                 names=[*batch.schema.names, "inside"])

    # a part is one task's again, in order: it is as large as the sort made it
    inside = laid.repartition("part").sortWithinPartitions("part", "place").mapInArrow(
        run, T.StructType([*laid.schema.fields, T.StructField("inside", T.LongType())]))
    keys = ["part", *([by] if by else [])]
    totals = laid.groupBy(*keys).agg(F.sum(value).alias("total"))
    bases = before(totals, "total", "base", [by] if by else None).select(
        F.col("part").alias("part_"), *([F.col(by).alias("by_")] if by else []), "base")
    match = F.col("part") == F.col("part_")
    if by:
        match = match & F.col(by).eqNullSafe(F.col("by_"))
    return inside.join(bases, match).select(
        *[c for c in columns if c not in ("part", "place")], (F.col("inside") + F.col("base")).alias("reach"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, least: int = LEAST,
         shares: dict[str, float] | None = None, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row, doc_id, source, n_tokens, ids and pieces (start, length, sequence_id, offset) per document.

    ``shares``: target tokens per source, any scale; sources that it leaves out, or all
    without it, have their share of the tokens. With the sources' own shares all queues end
    together, so every window meets the target; with others the queues that last longest
    fill the last windows, as every document is packed. A share of 0 is refused: its
    documents would never be packed. A document is cut where a turn of its queue ends and
    where a window ends. All sequences are full but the last.

    Null or empty text: the end id alone. A null source is a queue of its own. Equal ids and
    repeated rows stay separate documents. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    coded = written(encoded(slim, tokenizer, end_id), "packing-ids", compression="zstd")
    narrow = coded.select("row", "doc_id", "source", "n_tokens")
    queues = queue_totals(narrow, ["source", "doc_id", "row"], "n_tokens", "packing-queues", "source")
    turns = _turns(narrow, shares, window, least)
    met = queues.join(turns, F.col("source").eqNullSafe(F.col("queue")))
    first = F.col("reach") - F.col("n_tokens")
    # the turns that a document may meet; turns tile the queue, so empty ones can be dropped
    turn = F.explode(F.sequence(F.greatest(F.lit(1), F.floor(first / F.col("turn"))),
                                F.ceil(F.col("reach") / F.col("turn")) + 1))
    low = F.greatest(F.col("first"), F.floor((F.col("k") - 1) * F.col("turn")))
    high = F.least(F.col("reach"), F.floor(F.col("k") * F.col("turn")))
    served = met.select("row", "source", first.alias("first"), "reach", "turn", "rounds", turn.alias("k")).select(
        (F.col("k") * F.col("rounds")).alias("round"), "source", low.alias("place"), "row",
        (low - F.col("first")).alias("start"), (high - low).alias("length")).filter("length > 0") \
        .withColumnRenamed("place", "queue_place")
    stream = queue_totals(served, ["round", "source", "queue_place"], "length", "packing-stream")
    at = F.col("reach") - F.col("length")
    begin, end = F.floor(at / window), F.floor((F.col("reach") - 1) / window)
    cuts = stream.withColumn("at", at).withColumn("sequence_id", F.explode(F.sequence(begin, end)))
    low = F.greatest(F.col("at"), F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    placed = cuts.select("row", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
                         "sequence_id", (low - F.col("sequence_id") * window).alias("offset"))
    # a document's pieces: as many as its own tokens ask for
    per_row = placed.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    return coded.join(per_row, "row")


def _turns(narrow: DataFrame, shares: dict[str, float] | None, window: int, least: int) -> DataFrame:
    """Per queue the tokens of a turn, and the rounds that it saves for one."""
    weight = narrow.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("weight"))
    if shares:
        if min(shares.values()) <= 0:
            raise ValueError("every share must be above 0")
        given = narrow.sparkSession.createDataFrame(
            [(name, float(share)) for name, share in shares.items()], "name string, share double")
        scale = weight.join(given, F.col("source").eqNullSafe(F.col("name")), "left")
        covered = scale.filter("share is not null").agg(F.sum("weight"), F.sum("share")).first()
        factor = (covered[0] or 1.0) / (covered[1] or 1.0)
        weight = scale.select("source", F.coalesce(F.col("share") * factor, F.col("weight")).alias("weight"))
    every = weight.agg(F.sum("weight")).first()[0] or 1.0
    quantum = F.col("weight") / every * window
    rounds = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(least) / quantum))
    return weight.select(F.col("source").alias("queue"), rounds.alias("rounds"), (rounds * quantum).alias("turn"))


def pieces(packed: DataFrame, with_ids: bool = True) -> DataFrame:
    """The rows of ``pack`` as one row a piece, with its ids or only their crc32."""
    names = ["start", "length", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "ids"):
                found = part.column("pieces")
                counts = np.diff(found.offsets.to_numpy())
                flat = found.flatten()
                owner = np.repeat(np.arange(len(part)), counts)
                start, length = (flat.field(n).to_numpy() for n in ("start", "length"))
                sizes = part.column("n_tokens").to_numpy()
                crcs, bodies = [], []
                data = part.column("ids").to_pylist()
                held, at = None, -1
                for i, s, n in zip(owner.tolist(), start.tolist(), length.tolist()):
                    if i != at:
                        kind = "<u2" if len(data[i]) == 2 * sizes[i] else "<u4"
                        held, at = np.frombuffer(data[i], dtype=kind).astype("<u4"), i
                    ids = held[s:s + n]
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        bodies.append(ids.astype(np.int32))
                take = pa.array(owner)
                columns = [part.column("doc_id").take(take), part.column("source").take(take),
                           part.column("n_tokens").take(take), *(flat.field(n) for n in names),
                           pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array(bodies, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[
                    "doc_id", "source", "doc_tokens", *names, "ids_crc32", *(["ids"] if with_ids else [])])

    schema = ("doc_id long, source string, doc_tokens long, start long, length long, sequence_id long, "
              "offset long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return packed.select("doc_id", "source", "n_tokens", "ids", "pieces").mapInArrow(run, schema)
