"""A Merkle manifest with a witness per row, built by incremental appends.

Per group (a language) the leaves ascend by id and every two neighbours become a node until
one is left; the groups' roots, in the order of their names, become the dataset's root in
the same way. A group is cut into aligned blocks of ``2 ** BLOCK_LEVELS`` leaves. A task
appends a block's leaves one after the other: equal open subtrees join at once, and when a
sibling is complete its digest extends the partial witness of every leaf below the other
one. The roots of the blocks are then appends of the next round, with witnesses of their
own that continue those of the leaves, until a group has one node. No task holds more than
one block and no round's output is larger than its input.

A witness is the siblings' digests end to end, lowest level first. Which levels have a
sibling, and on which side, follows from the leaf's place and the number of leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import before, sorted_rows
from ..sources.scratch import written

#: Levels that one task builds: 4,096 leaves.
BLOCK_LEVELS = 12
SIZE = 32
#: Groups, of less than a kilobyte each, whose roots go to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000


# -- trees ------------------------------------------------------------------------------

def parent(left: bytes, right: bytes | None = None) -> bytes:
    """Digest of a node: its children's digests as hex text, one after the other."""
    return sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


class Subtree:
    """A finished subtree: its digest and the partial witnesses of the leaves below it."""

    __slots__ = ("level", "digest", "witnesses")

    def __init__(self, level: int, digest: bytes, witnesses: list[list[bytes]]):
        self.level, self.digest, self.witnesses = level, digest, witnesses

    def extended(self, sibling: bytes | None) -> list[list[bytes]]:
        if sibling is not None:
            for witness in self.witnesses:
                witness.append(sibling)
        return self.witnesses


class Witnesses:
    """Appends to one block: the open subtrees, largest first, each with its witnesses."""

    def __init__(self) -> None:
        self.open: list[Subtree] = []

    def append(self, digest: bytes) -> None:
        self._settle(Subtree(0, digest, [[]]))

    def _settle(self, new: Subtree) -> None:
        while self.open and self.open[-1].level == new.level:
            old = self.open.pop()
            digest = parent(old.digest, new.digest)
            new = Subtree(new.level + 1, digest, old.extended(new.digest) + new.extended(old.digest))
        self.open.append(new)

    def close(self, height: int) -> tuple[bytes, list[list[bytes]]]:
        """Digest at ``height`` and all witnesses; a last node without sibling is hashed alone."""
        while len(self.open) > 1 or self.open[0].level < height:
            last = self.open.pop()
            self._settle(Subtree(last.level + 1, parent(last.digest), last.witnesses))
        return self.open[0].digest, self.open[0].witnesses


def height_of(count: int) -> int:
    """Levels above the leaves until one node is left."""
    return (count - 1).bit_length()


def fold(digest: bytes, place: int, count: int, witness: bytes, at: int = 0) -> tuple[bytes, int]:
    """The root that a leaf at ``place`` of ``count`` leads to with its witness read from byte
    ``at``, and where the reading ended."""
    while count > 1:
        if place ^ 1 < count:
            sibling = witness[at:at + SIZE]
            at += SIZE
            digest = parent(sibling, digest) if place & 1 else parent(digest, sibling)
        else:
            digest = parent(digest)
        place, count = place >> 1, (count + 1) >> 1
    return digest, at


# -- places and rounds ------------------------------------------------------------------

def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``count`` within their group, in ``order``.

    Sorted ranges are numbered from one count per range and group; nothing sorts a whole
    group in one task. The last column of ``order`` must tell apart what should not be
    exchanged.
    """
    laid = sorted_rows(rows, [group, *order], name)
    sums = laid.groupBy("part", group).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    sums = before(sums, "n", "base", [group]).select(
        F.col("part").alias("part_"), F.col(group).alias("group_"), "base", "first")
    whole = laid.groupBy(F.col(group).alias("whole_")).agg(F.count("*").alias("count"))
    offsets = sums.join(whole, F.col("group_").eqNullSafe(F.col("whole_"))).drop("whole_")
    met = laid.join(offsets, (F.col("part") == F.col("part_")) & F.col(group).eqNullSafe(F.col("group_")))
    return met.select(*rows.columns, (F.col("place") - F.col("first") + F.col("base")).alias("place"), "count")


def blocks(nodes: DataFrame, group: str, name: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """One round of appends over ``nodes`` (``group``, place, count, digest, further columns).

    Gives the nodes with ``block``, ``witness`` (siblings inside the block), and the blocks'
    roots as nodes of the next round.
    """
    named = nodes.withColumn("block", F.shiftright("place", levels))
    columns = named.columns
    place, count, block, digest = (columns.index(c) for c in ("place", "count", "block", "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, key = Witnesses(), [], None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            n = table.column(count)[0].as_py()
            root, witnesses = held.close(min(levels, height_of(n)))
            table = table.append_column("witness", pa.array([b"".join(w) for w in witnesses], pa.binary()))
            # only the block's first row carries its root
            table = table.append_column("root", pa.array([root] + [None] * (len(table) - 1), pa.binary()))
            return table.to_batches()[0]

        for batch in batches:
            groups, numbers = batch.column(group).to_pylist(), batch.column(block).to_pylist()
            keys = list(zip(groups, numbers))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if rows and keys[a] != key:
                    yield done()
                    held, rows = Witnesses(), []
                key = keys[a]
                part = batch.slice(a, b - a)
                for leaf in part.column(digest).to_pylist():
                    held.append(leaf)
                rows.append(part)
        if rows:
            yield done()

    schema = ", ".join(f"`{c}` {t}" for c, t in named.dtypes) + ", witness binary, root binary"
    # a block is at most 2 ** levels rows, so no key is large
    laid = named.repartition(group, "block").sortWithinPartitions(group, "block", "place")
    made = written(laid.mapInArrow(run, schema), name)
    roots = made.filter("root is not null").select(
        group, F.col("block").alias("place"),
        F.ceil(F.col("count") / F.lit(1 << levels)).cast("bigint").alias("count"), F.col("root").alias("digest"))
    return made.drop("root"), roots


def rounds(nodes: DataFrame, group: str, name: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """Rounds until every group has one node: ``nodes`` with ``witness`` up to their group's
    root, and the roots (``group``, digest)."""
    done, above = blocks(nodes, group, name, levels)
    if above.agg(F.max("count")).first()[0] in (None, 1):
        return done.drop("block"), above.select(group, "digest")
    upper, roots = rounds(above, group, name, levels)
    upper = upper.select(F.col(group).alias("group_"), F.col("place").alias("block_"),
                         F.col("witness").alias("rest"))
    met = done.join(upper, F.col(group).eqNullSafe(F.col("group_")) & (F.col("block") == F.col("block_")))
    return met.drop("group_", "block_", "block").withColumn("witness", F.concat("witness", "rest")).drop("rest"), roots


# -- rows as leaves ---------------------------------------------------------------------

def field(value: Column) -> Column:
    """A value in a leaf: its number of UTF-8 bytes, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def manifest(docs: DataFrame, changed: Callable[[str], Column] | None = None, id_col: str = "doc_id",
             group_col: str = "lang", fields: Iterable[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             number_col: str = "n_chars", levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof (siblings from leaf to root), proof_sha256,
    folded_root and verified of every row; digests as hex text.

    ``changed`` gives a condition on the id under which ``number_col`` is read one higher
    when the witness is followed; ``verified`` says whether the root is still met.

    Null cells are a dash in the leaf; a null id comes first in its group, a null group
    before all others. Rows with one id are ordered by their leaf, so repeated rows may be
    exchanged without a difference. An empty table gives no rows. Other columns are not read.
    """
    names = list(fields)
    plain = leaf([F.col(c) for c in names])
    number = F.col(number_col)
    off = changed(id_col) if changed else F.lit(False)
    touched = F.coalesce(off & number.isNotNull(), F.lit(False))
    other = F.when(touched, leaf([number + 1 if c == number_col else F.col(c) for c in names]))
    leaves = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                                 F.col(group_col).cast("string").alias("lang"), plain.alias("digest"),
                                 other.alias("other")), "manifest-leaves")
    # rows that agree in id and leaf are exchangeable; the mark keeps them from being one range
    marked = leaves.withColumn("mark", F.monotonically_increasing_id())
    nodes = placed(marked, "lang", ["doc_id", "digest", "mark"], "manifest-places").drop("mark")
    inside, subroots = rounds(nodes, "lang", "manifest-block", levels)
    # the groups' roots are the leaves of one more tree
    tops = placed(subroots.withColumn("whole", F.lit(0)), "whole", ["lang"], "manifest-groups")
    crowned, root = rounds(tops, "whole", "manifest-crown", levels)
    crowned = crowned.select(F.col("lang").alias("lang_"), F.col("digest").alias("subroot"),
                             F.col("place").alias("group_place"), F.col("count").alias("groups"),
                             F.col("witness").alias("crown"), F.lit(0).alias("whole_"))
    crowned = crowned.join(root.select(F.col("whole").alias("whole_0"), F.col("digest").alias("root")),
                           F.col("whole_") == F.col("whole_0"))
    few = subroots.count() <= BROADCAST_GROUPS
    met = inside.join(F.broadcast(crowned) if few else crowned, F.col("lang").eqNullSafe(F.col("lang_")))
    rows = met.select("doc_id", "lang", "place", "count", "digest", "other", "subroot", "root",
                      F.concat("witness", "crown").alias("proof"), "group_place", "groups")
    return rows.mapInArrow(_followed, "doc_id long, lang string, leaf string, subroot string, root string, "
                           "proof binary, proof_sha256 string, folded_root string, verified boolean")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow every row's witness from its leaf as it is read now."""
    for batch in batches:
        digest, folded, verified = [], [], []
        names = ("place", "count", "digest", "other", "root", "proof", "group_place", "groups")
        for place, count, leaf_, other, root, proof, upper, groups in zip(
                *(batch.column(n).to_pylist() for n in names)):
            sub, at = fold(other or leaf_, place, count, proof)
            found, _ = fold(sub, upper, groups, proof, at)
            digest.append(sha256(proof.hex().encode()).hexdigest())
            folded.append(found.hex())
            verified.append(found == root)
        texts = [pa.array([d.hex() for d in batch.column(n).to_pylist()], pa.string())
                 for n in ("digest", "subroot", "root")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), *texts, batch.column("proof"),
             pa.array(digest, pa.string()), pa.array(folded, pa.string()), pa.array(verified, pa.bool_())],
            names=["doc_id", "lang", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])
