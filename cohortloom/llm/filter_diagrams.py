"""How filters interact: count-weighted decision diagrams of failure masks.

Every document is one mask of the filters that it fails. Per part the masks' counts become
an ordered decision diagram: a level per filter, a node's weight the documents below it, and
equal subdiagrams stored once. One diagram serves all orders: a swap of two neighbouring
levels leads from each order to the next, and the path on which every filter passes gives
that order's steps. Only the counts of masks reach a diagram, so its size does not follow
the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import UPPER, steps, utf8

#: The filters of ``audit`` in the order of their mask bits; the last one looks at other rows.
FILTERS = "ABCDE"
#: Fixed thresholds: words, percent of distinct words, percent of capitals, marks.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"

Weight = tuple[int, ...]


# -- diagrams ---------------------------------------------------------------------------

class Diagram:
    """An ordered decision diagram over ``variables`` whose leaves carry weights.

    A node is (pass, fail), the nodes below it; nodes are numbered by content, so equal
    subdiagrams are one. No level is skipped: the path of a mask has a node per filter.
    """

    def __init__(self, variables: str, weights: dict[int, Weight]):
        self.order = list(variables)
        self._zero = (0,) * len(next(iter(weights.values()), ()))
        self._ids: dict[object, int] = {}
        self.below: list[tuple[int, int] | None] = []
        self.weight: list[Weight] = []
        layer = [self._leaf(weights.get(mask, self._zero)) for mask in range(1 << len(variables))]
        # bit i of a mask belongs to level i, so the last bit's pairs are joined first
        while len(layer) > 1:
            half = len(layer) // 2
            layer = [self._node(layer[i], layer[i + half]) for i in range(half)]
        self.root = layer[0]

    def _leaf(self, weight: Weight) -> int:
        return self._add(("leaf", weight), None, weight)

    def _node(self, passing: int, failing: int) -> int:
        known = self._ids.get((passing, failing))
        if known is not None:
            return known
        total = tuple(map(sum, zip(self.weight[passing], self.weight[failing])))
        return self._add((passing, failing), (passing, failing), total)

    def _add(self, key: object, below: tuple[int, int] | None, weight: Weight) -> int:
        if key not in self._ids:
            self._ids[key] = len(self.below)
            self.below.append(below)
            self.weight.append(weight)
        return self._ids[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; what lies below both is kept."""
        done: dict[tuple[int, int], int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if (node, depth) not in done:
                passing, failing = self.below[node]
                if depth < level:
                    made = self._node(rebuilt(passing, depth + 1), rebuilt(failing, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.below[passing], self.below[failing]
                    made = self._node(self._node(pp, fp), self._node(pf, ff))
                done[node, depth] = made
            return done[node, depth]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, Weight, Weight]]:
        """(filter, weight kept, weight removed) along the path on which every filter passes."""
        out, node = [], self.root
        for name in self.order:
            node, failing = self.below[node]
            out.append((name, self.weight[node], self.weight[failing]))
        return out


def level_swaps(n: int) -> Iterator[int]:
    """Levels to swap with their next, one after the other, so that every order of n comes once.

    The last variable sweeps through the others; each time it stands at an end, the others
    make one step of their own sequence.
    """
    if n < 2:
        return
    others, up = level_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if up else range(n - 1)
        step = next(others, None)
        if step is None:
            return
        yield step + up
        up = not up


def part_steps(variables: str, weights: dict[int, Weight]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all
    orders; a weight is (documents, good ones, toxic ones) of a mask."""
    diagram = Diagram(variables, weights)
    fails = {v: sum(w[0] for m, w in weights.items() if m >> i & 1) for i, v in enumerate(variables)}
    alone = {v: weights.get(1 << i, (0,))[0] for i, v in enumerate(variables)}
    rows, shares = [], dict.fromkeys(variables, 0)

    def walk() -> None:
        order = "".join(diagram.order)
        for i, (name, kept, removed) in enumerate(diagram.steps()):
            shares[name] += removed[0]
            rows.append((order, i + 1, kept[0], removed[0], fails[name] - removed[0], alone[name],
                         removed[1], removed[2]))

    walk()
    for level in level_swaps(len(variables)):
        diagram.swap(level)
        walk()
    return [(*row, shares[row[0][row[1] - 1]]) for row in rows]


def interactions(counted: DataFrame, variables: str) -> DataFrame:
    """The steps of every order per part, from rows (part, mask, documents, good, toxic).

    A part has at most one row a mask, so a task holds 2 ** len(variables) rows.
    """
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
             "toxic_lost", "shapley"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {int(m): (int(n), int(g), int(t)) for m, n, g, t in
                   zip(rows["mask"], rows["documents"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(part_steps(variables, weights), columns=names)
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names[2:])
    return counted.groupBy("part").applyInPandas(run, schema)


# -- masks of documents -----------------------------------------------------------------

def text_mask(text: bytes, points: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails."""
    words = text.split()  # bytes part at space and tab to carriage return only
    capitals = len(text) - len(text.translate(None, UPPER.encode()))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 \
        | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest (128 bits of the text's sha256) and mask (A to D) per row; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "text"):
                texts = utf8(piece, "text")
                points = pc.utf8_length(piece.column("text")).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("part"),
                     pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()),
                     pa.array(map(text_mask, texts, points), pa.int32())],
                    names=["doc_id", "part", "digest", "mask"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """(part, mask, documents, good, toxic): how many documents of a part fail just these filters.

    E holds for a row whose text stands under a smaller id anywhere. All groupings combine
    before they shuffle, so neither one text, id or part on most rows makes a large group.
    """
    found = masks(docs, id_col, text_col, part_col).groupBy("digest", "doc_id", "part", "mask").agg(
        F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = written(found.join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
        "digest", "doc_id", "part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")), "filter-masks")
    copy = 1 << FILTERS.index("E")
    values = ["n", "good", "toxic"]
    # rows that pass E: those of the least id of a text, in whatever parts, and those without id
    held = F.struct("part", "mask", *values)
    first = rows.filter("doc_id is not null").groupBy("digest", "doc_id").agg(F.collect_list(held).alias("rows")) \
        .groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows"))
    passing = first.unionByName(rows.filter("doc_id is null").select(*first.columns)) \
        .groupBy("part", "mask").agg(*[F.sum(v).alias(v) for v in values])
    every = rows.groupBy("part", "mask").agg(*[F.sum(v).alias(v) for v in values])
    failing = every.unionByName(passing.select("part", "mask", *[(-F.col(v)).alias(v) for v in values])) \
        .withColumn("mask", F.col("mask").bitwiseOR(F.lit(copy)))
    return failing.unionByName(passing).groupBy("part", "mask").agg(
        F.sum("n").alias("documents"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley:
    a row per part, order of the five filters and step.

    A null text is empty (it fails A, and E beside another empty one); a null part is the
    empty string. A row without id fails E never and has no label. Repeated rows count each,
    and rows with one id and text are all the first. Where an id has several labels, any
    quality or toxic mark counts. An empty table gives no rows. Other columns are not read.
    """
    return interactions(mask_counts(docs, labels, id_col, text_col, part_col), FILTERS)
