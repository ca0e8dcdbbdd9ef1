"""Shards cut from a Hilbert-curve order of several metadata columns.

Each column is quantised at its own approximate quantiles, the cell's index along the
Hilbert curve orders the rows, and equal runs of that order become shards. Rows that are
near in every column lie in few shards, so the ranges of a shard prune files on any of them.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import before, sorted_rows
from ..sources.scratch import written

#: Bits of a column's cell; the curve has 2 ** (bits * columns) cells.
BITS = 5


def _common_prefix(low: str | None, high: str | None) -> int:
    """Leading characters that all values between two strings share."""
    n = 0
    for a, b in zip(low or "", high or ""):
        if a != b:
            break
        n += 1
    return n


def _scale(kind: T.DataType, name: str, shared: int) -> Column:
    """A column as a number in the same order; text by the six bytes after the prefix all values share."""
    if isinstance(kind, T.StringType):
        tail = F.rpad(F.hex(F.encode(F.substring(F.col(name), shared + 1, 6), "UTF-8")), 12, "0")
        return F.conv(tail, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def curve_index(cells: list[Column], bits: int) -> Column:
    """Hilbert index of a point with ``bits`` bits a dimension, as one expression.

    The loop over bit planes is an ``aggregate`` over (plane, dimension) steps: each step
    either inverts or exchanges the low bits of the first coordinate; then the coordinates
    are Gray-coded and their bits interleaved.
    """
    n = len(cells)
    if n == 1:
        return cells[0].cast("long")
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i"))
                      for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        chosen = F.get(x, s["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(chosen).bitwiseAND(low)
        set_ = chosen.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(
            k == 0, F.when(set_, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap)))
            .when((k == s["i"]) & ~set_, v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        # every coordinate becomes the xor of itself and all before it
        return F.transform(x, lambda _, k: F.aggregate(
            F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def flip(x: Column) -> Column:
        planes = F.array(*[F.lit(1 << q) for q in range(bits - 1, 0, -1)])
        turn_by = F.aggregate(planes, F.lit(0), lambda a, q: F.when(
            F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(x, lambda v: v.bitwiseXOR(turn_by))

    def interleave(x: Column) -> Column:
        places = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i"))
                           for q in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a * 2 + F.get(
            x, p["i"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << q) for q in range(bits)]), p["q"] + 1))
            .cast("boolean").cast("long"))

    point = F.array(*[c.cast("int") for c in cells])
    turned = F.aggregate(steps, point, turn)
    # a one-element transform names an intermediate array inside the expression
    named = [turned]
    for stage in (gray, flip, interleave):
        named.append(F.get(F.transform(F.array(named[-1]), stage), F.lit(0)))
    return named[-1]


def quantised(rows: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """The cell of each column, 0 to 2 ** bits - 1, cut at the table's approximate quantiles.

    One aggregate over the whole table yields at most 2 ** bits - 1 bounds a column. Null
    is the lowest cell.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    text = [d for d in dims if isinstance(kinds[d], T.StringType)]
    shared = {d: 0 for d in dims}
    if text:
        ends = rows.agg(*[F.min(d).alias(f"low{i}") for i, d in enumerate(text)],
                        *[F.max(d).alias(f"high{i}") for i, d in enumerate(text)]).first()
        shared |= {d: _common_prefix(ends[f"low{i}"], ends[f"high{i}"]) for i, d in enumerate(text)}
    scaled = [_scale(kinds[d], d, shared[d]) for d in dims]
    parts = 1 << bits
    cuts = [k / parts for k in range(1, parts)]
    found = rows.agg(*[F.percentile_approx(c, cuts, 10_000).alias(f"b{i}")
                       for i, c in enumerate(scaled)]).first()
    cells = []
    for i, c in enumerate(scaled):
        bounds = sorted(set(found[f"b{i}"] or ()))
        if not bounds:
            cells.append(F.lit(0))
            continue
        cells.append(F.coalesce(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), _below(c))),
                                F.lit(0)))
    return cells


def _below(value: Column):
    return lambda bound: bound < value


def shards(docs: DataFrame, dims: list[str], n_shards: int, law: str = "rows", id_col: str = "doc_id",
           text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, the dims (as d_<name>), curve, shard and slot of every row.

    ``rows``: shard sizes differ by one row at most. ``bytes``: cuts fall at equal shares of
    the total size. Sizes are UTF-8 bytes plus 16, null text as empty. Only these narrow
    columns are sorted. Rows are dealt by ranges of (curve, dims, size, id), so a crowded
    cell spreads over as many tasks as it fills; full ties are identical rows, whose order
    cannot show. Null ids and dims sort first; an empty table has no rows. Dims named like
    the output columns do not clash.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    names = [f"d_{d}" for d in dims]
    body = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       (F.octet_length(body) + 16).cast("bigint").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
                       *[F.col(d).alias(n) for d, n in zip(dims, names)])
    slim = written(slim, "shard-columns")
    placed = slim.withColumn("curve", curve_index(quantised(slim, names, bits), bits))
    rows = sorted_rows(placed, ["curve", *names, "size", "doc_id", "text_crc32"], "shard-order")
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    bases = before(before(totals, "n", "rows_before"), "bytes", "bytes_before") \
        .select("part", "rows_before", "bytes_before")
    every = totals.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    # one row per part: the number of tasks bounds what is sent to all
    out = rows.join(F.broadcast(bases), "part").withColumn("rank", F.col("rows_before") + F.col("place"))
    n_all, bytes_all = F.lit(every["n"] or 1), F.lit(every["bytes"] or 1)
    if law == "rows":
        return out.withColumn("shard", _share(F.col("rank"), n_shards, n_all)).withColumn(
            "slot", F.col("rank") - _first(F.col("shard"), n_shards, n_all)).select(
            "doc_id", "size", "text_crc32", *names, "curve", "shard", "slot")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = out.withColumn("at", at).withColumn("shard", _share(F.col("at"), n_shards, bytes_all))
    firsts = F.broadcast(cut.groupBy("shard").agg(F.min("rank").alias("first_rank")))  # a row per shard
    return cut.join(firsts, "shard").withColumn("slot", F.col("rank") - F.col("first_rank")).select(
        "doc_id", "size", "text_crc32", *names, "curve", "shard", "slot")


def _share(at: Column, n_shards: int, of: Column) -> Column:
    return F.floor((at * n_shards).cast("decimal(38,0)") / of.cast("decimal(38,0)")).cast("int")


def _first(shard: Column, n_shards: int, of: Column) -> Column:
    """The least rank whose share of all ranks reaches the shard."""
    return F.floor((shard.cast("bigint") * of + (n_shards - 1)).cast("decimal(38,0)") / n_shards).cast("bigint")


def ranges(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard its rows, bytes and the lowest and highest value of each dim: what prunes files."""
    ends = reduce(list.__add__, [[F.min(f"d_{d}").alias(f"{d}_low"), F.max(f"d_{d}").alias(f"{d}_high")]
                                 for d in dims], [])
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents in shard folders, each sorted along the curve; needs unique ids.

    One shuffle of the texts, by ranges of (shard, slot), so large shards take several tasks.
    """
    place = assigned.select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.join(place, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .drop("slot").write.partitionBy("shard").parquet(path)
