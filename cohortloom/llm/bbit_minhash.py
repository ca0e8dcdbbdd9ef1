"""Near-duplicates by b-bit MinHash.

A text's set of word shingles gives ``BANDS * ROWS`` minima. Texts that agree in all minima
of a band become candidates; only the low ``BITS`` bits of each minimum are kept beside
them, packed, and equal bits, corrected for chance collisions, estimate the similarity.
Candidates whose estimate is not clearly too low form groups; inside a group the full sets
decide every link.

Equal sets are one class throughout, whatever their number. Within a bucket or group the
work goes by pivots: a member is compared with all that it is not yet connected to, taking
pivots from the smaller side, until everything left is in one piece. That finds the exact
components of the similarity graph without forming all pairs. Groups over a size bound are
split over tasks: first in blocks that share anchors, then the members outside the largest
piece against every block, which covers every pair of different pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import LOWER, UPPER, keyed_text, map_texts, steps, utf8
from .components import components

BANDS, ROWS, BITS = 32, 4, 4
#: Standard deviations below the threshold at which an estimate still asks for an exact check.
MARGIN = 4.5
#: Members of a bucket, and elements of a group's sets, that one task takes; beyond: blocks.
BUCKET_ROWS, GROUP_ELEMENTS = 4_000, 4_000_000
#: Members that every block of an oversized group holds, so blocks connect through them.
ANCHORS = 32
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_NO_ID = (1 << 63) - 1

Compare = Callable[[int, np.ndarray], np.ndarray]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts end to end, sorted within a text, and bounds.

    A text with fewer words than ``width`` has its whole word sequence as the one shingle;
    one without words has none. Only A-Z are lowered; words part at ASCII blanks.
    """
    import xxhash
    split = [t.translate(_LOWER).split() if t else [] for t in texts]
    codes: dict[bytes, int] = {}
    for words in split:
        codes.update(dict.fromkeys(words, 0))
    number = xxhash.xxh3_64_intdigest
    for word in codes:
        codes[word] = number(word)
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.fromiter((codes[w] for words in split for w in words), dtype=np.uint64,
                       count=int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = len(flat)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled = _mix(rolled ^ flat[k:k + len(rolled)])
    counts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(split)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    hashes = rolled[at]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        whole = [0] * len(short)
        for j, i in enumerate(short.tolist()):
            h = np.zeros(1, dtype=np.uint64)
            for w in flat[starts[i]:starts[i + 1]]:
                h = _mix(h ^ w)
            whole[j] = int((h ^ np.uint64(len(split[i])))[0])  # apart from full shingles
        hashes = np.concatenate([hashes, np.array(whole, dtype=np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(split) + 1))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return (rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, n, dtype=np.uint64))


def minima(hashes: np.ndarray, bounds: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Minima of each non-empty set under ``n`` hash functions: sets by functions."""
    factor, salt = _permutations(n)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    out = np.full((len(sizes), n), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = 16_384  # elements that stay in the processor's cache, or one longer set
    begin = 0
    while begin < len(some):
        end = begin + 1
        while end < len(some) and bounds[some[end] + 1] - bounds[some[begin]] <= step:
            end += 1
        part = hashes[bounds[some[begin]]:bounds[some[end - 1] + 1]]
        cuts = bounds[some[begin:end]] - bounds[some[begin]]
        for k in range(n):
            out[some[begin:end], k] = np.minimum.reduceat((part ^ salt[k]) * factor[k], cuts)
        begin = end
    return out


def packed(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` (1, 2, 4 or 8) bits of mixed minima, packed to bytes: sets by bytes."""
    low = (_mix(mins) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    low = low.reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint8) * bits), axis=2).astype(np.uint8)


def equal_slots(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Slots on which signatures agree, by counting bits of their difference."""
    diff = np.bitwise_xor(a, b).view(np.uint64)
    shift = 1
    while shift < bits:
        diff = diff | (diff >> np.uint64(shift))
        shift *= 2
    mask = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    slots = 64 // bits * diff.shape[1]
    return slots - np.bitwise_count(diff & mask).sum(axis=1).astype(np.int64)


def estimate(equal: np.ndarray, slots: int, bits: int = BITS) -> np.ndarray:
    """Similarity from agreeing slots, less the share that agrees by chance."""
    chance = 2.0 ** -bits
    return (equal / slots - chance) / (1 - chance)


def _least_equal(threshold: float, slots: int, bits: int) -> int:
    chance = 2.0 ** -bits
    p = chance + (1 - chance) * threshold
    return int(np.floor(slots * p - MARGIN * np.sqrt(slots * p * (1 - p))))


def _pieces(n: int, compare: Compare, start: np.ndarray | None = None,
            first: list[int] | None = None, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what ``compare`` connects: a spanning forest, not all pairs.

    ``compare(i, others)`` marks which of ``others`` are linked to i. ``start``: known pieces.
    ``only``: marks the members whose pairs are wanted (others were compared elsewhere).
    """
    piece = np.arange(n) if start is None else np.unique(start, return_inverse=True)[1]
    open_ = np.ones(n, dtype=bool) if only is None else only.copy()
    links = []
    queue = list(first or ())
    while True:
        if queue:
            i = queue.pop()
        else:
            left = np.flatnonzero(open_)
            if not len(left):
                break
            names, counts = np.unique(piece[left], return_counts=True)
            if only is None and len(names) == 1:
                break
            # a pivot from the smallest piece left: the largest is never worked through
            i = int(left[np.argmax(piece[left] == names[np.argmin(counts)])])
        others = np.flatnonzero((piece != piece[i]) & (open_ if only is None else True))
        open_[i] = False
        if len(others):
            for j in others[compare(i, others)].tolist():
                if piece[j] != piece[i]:
                    piece[piece == piece[j]] = piece[i]
                    links.append((i, j))
    return links


def _linked(groups: DataFrame, most: int, judge: Callable, name: str) -> DataFrame:
    """Links (a, b) that connect, within each ``grp``, what the judge's comparison connects.

    ``groups``: grp, id, n, load and weight. A group up to ``most`` is one task's; a larger
    one is dealt in blocks by a hash of the id, each with the group's anchors, and then,
    under the pieces found so far, the members outside its largest piece meet all.
    """
    sizes = written(groups.groupBy("grp").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("members"))
                    .filter("members > 1")
                    .withColumn("blocks", F.ceil(F.col("total") / most).cast("int")), f"{name}-sizes")
    row = ["grp", "block", "id", "n", "load"]
    small = groups.join(sizes.filter("blocks = 1").select("grp"), "grp").withColumn("block", F.lit("0"))
    links = _in_groups(small.select(*row), judge)
    large = sizes.filter("blocks > 1").select("grp", "blocks", "members")
    if large.isEmpty():
        return written(links, f"{name}-links")
    big = written(groups.join(large, "grp"), f"{name}-large")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # the members with the least hashes, about ANCHORS a group, go to every block
    anchor = F.pmod(F.xxhash64("id", F.lit("anchor")), F.lit(1 << 32)) * F.col("members") \
        < F.lit(ANCHORS * float(1 << 32))
    dealt = big.withColumn("block", F.explode(F.when(anchor, blocks).otherwise(F.array(block)))) \
        .withColumn("block", F.col("block").cast("string"))
    links = written(links.unionByName(_in_groups(dealt.select(*row), judge)), f"{name}-links")
    # what is still apart: members outside the largest piece of their group, against everyone
    known = big.select("grp", "id").join(components(links, f"{name}-pieces"), "id", "left") \
        .withColumn("piece", F.coalesce("component", "id"))
    counts = known.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("grp").agg(F.max_by("piece", F.struct("k", "piece")).alias("largest"),
                                        F.count(F.lit(1)).alias("pieces")).filter("pieces > 1")
    known = known.join(largest, "grp").select("grp", "id", "piece", "largest")
    full = big.join(known, ["grp", "id"])
    per = full.filter("piece <> largest").groupBy("grp").agg(
        F.ceil(F.sum("weight") / most).cast("int").alias("asking"))
    full = written(full.join(per, "grp"), f"{name}-apart")
    ask = F.pmod(F.xxhash64("id", F.lit("ask")), F.col("asking")).cast("int")
    asks = full.filter("piece <> largest").withColumn("ask", ask).withColumn("part", F.explode(blocks)) \
        .withColumn("asks", F.lit(True))
    asked = full.withColumn("part", block).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).withColumn("asks", F.lit(False))
    meets = asks.select("grp", "ask", "part", "id", "n", "load", "piece", "asks").unionByName(
        asked.select("grp", "ask", "part", "id", "n", "load", "piece", "asks")) \
        .withColumn("block", F.concat_ws("-", "ask", "part"))
    more = _in_groups(meets.select(*row, "piece", "asks"), judge)
    return links.unionByName(written(more, f"{name}-more"))


def _in_groups(rows: DataFrame, judge: Callable) -> DataFrame:
    """Run the judge over each (grp, block), many small groups to a batch."""
    asking = "asks" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            cuts = _group_cuts(now)
            yield _judged(now.slice(0, cuts[-1]), cuts, judge, asking)
            held = now.slice(cuts[-1])
        if held is not None and len(held):
            yield _judged(held, np.array([0, len(held)]), judge, asking)

    laid = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "id")
    return laid.mapInArrow(run, "a long, b long")


def _group_cuts(rows: pa.Table) -> np.ndarray:
    """Where groups begin; the last one may go on in the next batch."""
    grp = rows.column("grp").to_numpy()
    block = rows.column("block").combine_chunks().dictionary_encode()
    block = (block.combine_chunks() if isinstance(block, pa.ChunkedArray) else block).indices.to_numpy()
    new = np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1
    return np.concatenate([[0], new])


def _judged(rows: pa.Table, cuts: np.ndarray, judge: Callable, asking: bool) -> pa.RecordBatch:
    """Links of all groups between the cuts."""
    links: list[tuple[np.ndarray, np.ndarray]] = []
    if len(rows):
        rows = rows.combine_chunks()
        ids = rows.column("id").to_numpy()
        size = rows.column("n").to_numpy()
        compare_in = judge(rows.column("load").combine_chunks(), size)
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)][:len(cuts)]):
            if e - s < 2:
                continue
            start = only = None
            take = np.arange(s, e)
            if asking:
                # a member that asks may also come as one that is asked: keep it once, asking
                asks = rows.column("asks").to_numpy()[s:e]
                order = np.lexsort((~asks, ids[s:e]))
                first = np.ones(e - s, dtype=bool)
                first[1:] = ids[s:e][order][1:] != ids[s:e][order][:-1]
                take = s + order[first]
                only = asks[order[first]]
                start = rows.column("piece").to_numpy()[take]
            found = _pieces(len(take), compare_in(take), start, None if asking else [0], only)
            if found:
                pair = take[np.array(found)]
                links.append((ids[pair[:, 0]], ids[pair[:, 1]]))
    a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in links]) if links else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _by_signature(least: int, percent: int) -> Callable:
    """Comparison by estimate; sizes too different for the threshold need none."""
    def judge(load: pa.Array, size: np.ndarray) -> Callable:
        sig = np.frombuffer(b"".join(load.to_pylist()), dtype=np.uint8).reshape(len(size), -1)

        def compare_in(take: np.ndarray) -> Compare:
            own, n = sig[take], size[take]

            def compare(i: int, others: np.ndarray) -> np.ndarray:
                low, high = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
                return (equal_slots(own[i:i + 1], own[others]) >= least) & (100 * low >= percent * high)
            return compare
        return compare_in
    return judge


def _by_sets(percent: int) -> Callable:
    """Comparison by the full sets: 100 * shared >= percent * united."""
    def judge(load: pa.Array, size: np.ndarray) -> Callable:
        sets = [np.frombuffer(x, dtype="<u8") for x in load.to_pylist()]

        def compare_in(take: np.ndarray) -> Compare:
            own = [sets[i] for i in take.tolist()]
            n = size[take]
            if len(own) < 8:
                def shared_with(i: int, chosen: np.ndarray) -> np.ndarray:
                    return np.array([len(np.intersect1d(own[i], own[j], assume_unique=True))
                                     for j in chosen.tolist()], dtype=np.int64)
            else:
                begin = np.concatenate([[0], np.cumsum(n)])
                names, codes = np.unique(np.concatenate(own), return_inverse=True)
                marks = np.zeros(len(names), dtype=bool)

                def shared_with(i: int, chosen: np.ndarray) -> np.ndarray:
                    mine = codes[begin[i]:begin[i + 1]]
                    marks[mine] = True
                    if len(chosen) * 4 > len(own):  # most of them: one pass over everything
                        hits = np.concatenate([[0], np.cumsum(marks[codes])])
                        out = hits[begin[chosen + 1]] - hits[begin[chosen]]
                    else:
                        out = np.array([np.count_nonzero(marks[codes[begin[j]:begin[j + 1]]])
                                        for j in chosen.tolist()], dtype=np.int64)
                    marks[mine] = False
                    return out

            def compare(i: int, others: np.ndarray) -> np.ndarray:
                # only sets of a size that can reach the threshold are counted
                low, high = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
                able = np.flatnonzero(100 * low >= percent * high)
                out = np.zeros(len(others), dtype=bool)
                if len(able):
                    chosen = others[able]
                    shared = shared_with(i, chosen)
                    out[able] = 100 * shared >= percent * (n[chosen] + n[i] - shared)
                return out
            return compare
        return compare_in
    return judge


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, mark, n (set size), s1, s2 (128-bit hash of the set), bands, sig: one pass, no shuffle."""
    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_sets(utf8(part, "text"), width)
        sizes = np.diff(bounds)
        mins = minima(hashes, bounds)
        bands = np.zeros((len(sizes), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            bands = _mix(bands ^ mins[:, r::ROWS])
        bands = _mix(bands ^ np.arange(BANDS, dtype=np.uint64))
        s1, s2 = _set_hash(hashes, bounds)
        sig = packed(mins)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("mark"), pa.array(sizes, pa.int64()), pa.array(s1.view(np.int64)),
             pa.array(s2.view(np.int64)),
             pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32),
                                      pa.array(bands.reshape(-1).view(np.int64))),
             pa.array([s.tobytes() for s in sig], pa.binary())],
            names=["doc_id", "mark", "n", "s1", "s2", "bands", "sig"])

    return map_texts(docs, "doc_id long, mark long, n long, s1 long, s2 long, bands array<long>, sig binary", look)


def _set_hash(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed elements: equal for equal sets, apart else but for chance in 2^128."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ np.uint64(salt)),
                                                                  dtype=np.uint64)])
        out.append(total[bounds[1:]] - total[bounds[:-1]])
    return out[0], out[1]


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row.

    Links join rows whose shingle sets reach ``percent`` of shared to united shingles;
    component_id is the least id reachable and that row is kept. Texts without words are
    alone. Rows with equal ids are one document for the result; a missing id ranks after
    every other and gives component_id null only if the whole component lacks ids (those
    rows are kept). Empty tables give no rows; extra columns are not read.
    """
    slim = keyed_text(docs, id_col, text_col).withColumn(
        "doc_id", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("mark", F.xxhash64("text"))
    signed = written(signatures(slim, width), "bbit-signatures")
    filled = signed.filter("n > 0")
    # classes go by a number of their own: ids may repeat between different texts
    classes = written(filled.groupBy("s1", "s2", "n").agg(
        F.min(F.struct("doc_id", "mark")).alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .withColumn("cls", F.monotonically_increasing_id()), "bbit-classes") \
        .withColumns({"least_id": F.col("least.doc_id"), "least_mark": F.col("least.mark")})
    entries = classes.select(F.explode("bands").alias("grp"), F.col("cls").alias("id"))
    crowded = entries.groupBy("grp").agg(
        F.count(F.lit(1)).alias("k"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")).filter("k > 1")
    # bands that put the same classes together are one bucket
    buckets = crowded.groupBy("k", "low", "high", "x1", "x2").agg(F.min("grp").alias("grp")).select("grp")
    load = classes.select(F.col("cls").alias("id"), "n", F.col("sig").alias("load"))
    entries = entries.join(buckets, "grp").join(load, "id").withColumn("weight", F.lit(1).cast("bigint"))
    least = _least_equal(percent / 100, BANDS * ROWS, BITS)
    likely = _linked(entries, BUCKET_ROWS, _by_signature(least, percent), "bbit-likely")
    groups = components(likely, "bbit-groups")
    # the full sets of the classes in groups, read again from the texts
    wanted = groups.join(classes.select(F.col("cls").alias("id"), F.col("least_id").alias("want_id"),
                                        F.col("least_mark").alias("want_mark"), "s1", "s2"),
                         "id").select("want_id", "want_mark", "s1", "s2", F.col("component").alias("grp"),
                                      F.col("id").alias("cls"))
    again = slim.join(wanted, (F.col("doc_id") == F.col("want_id")) & (F.col("mark") == F.col("want_mark")))
    sets = written(_sets(again, width).dropDuplicates(["id"]), "bbit-sets").withColumn("weight", F.col("n"))
    links = _linked(sets, GROUP_ELEMENTS, _by_sets(percent), "bbit-exact")
    found = components(links, "bbit-components")
    named = classes.select("cls", "s1", "s2", "n", "least_id") \
        .join(found.withColumnRenamed("id", "cls"), "cls", "left") \
        .withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = named.join(lowest, "component").select("s1", "s2", "n", "component_id")
    out = filled.select("doc_id", "n", "s1", "s2").join(placed, ["s1", "s2", "n"]).select(
        "doc_id", "n", "component_id").unionByName(
        signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.nullif("component_id", F.lit(_NO_ID)).alias("component_id"),
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _sets(joined: DataFrame, width: int) -> DataFrame:
    """The class's sorted set of each text that is of its class (an id may stand for several texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                hashes, bounds = shingle_sets(utf8(part, "text"), width)
                s1, s2 = _set_hash(hashes, bounds)
                same = (s1.view(np.int64) == part.column("s1").to_numpy()) & \
                    (s2.view(np.int64) == part.column("s2").to_numpy())
                keep = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp").take(pa.array(keep)), part.column("cls").take(pa.array(keep)),
                     pa.array(np.diff(bounds)[keep], pa.int64()),
                     pa.array([hashes[bounds[i]:bounds[i + 1]].tobytes() for i in keep], pa.binary())],
                    names=["grp", "id", "n", "load"])

    return joined.select("text", "s1", "s2", "grp", "cls").mapInArrow(
        run, "grp long, id long, n long, load binary")


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not near-duplicates of a row with a lesser id.

    Rows with equal ids stay or go together; rows without an id stay.
    """
    gone = near_duplicates(docs, percent, width, id_col, text_col).filter("not kept") \
        .select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col("gone_id"), "left_anti")
