"""A text classifier over learned subword vectors.

A word is its own hashed vector and those of its character n-grams; a word that repeats the
one before it adds the vector of the repeated pair, whatever the word. A text is the average
of the vectors of all its words, and a softmax over two outputs scores it. The vectors are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; the
whole table is then scored in the tasks. For two outputs the softmax needs only the
difference of the two scores, and that difference is linear in the vectors, so scoring uses
one number per bucket: the vector times the difference of the output weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_texts

#: Buckets of the end mark and of the repeated pair; words may hash to them too.
_END, _AGAIN = 0, 1


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the driver trains on; each brings at most its
    distinct buckets, never its text. Everything else is scored, not sampled."""
    sample: int = 3_000
    buckets: int = 1 << 17
    dim: int = 12
    shortest: int = 2
    longest: int = 4
    epochs: int = 6
    rate: float = 0.1
    seed: int = 7


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: distinct words with their buckets, each text's words as codes and
    how many of them repeat the word before."""
    codes: np.ndarray
    bounds: np.ndarray
    repeats: np.ndarray
    buckets: np.ndarray
    reach: np.ndarray


def words_of(texts: pa.Array, settings: Settings) -> Words:
    """Split at ASCII blanks; buckets are computed once for each distinct word of the call.

    The buckets of word w are ``buckets[reach[w]:reach[w + 1]]``: one for the word and one
    for each n-gram of its characters between ``<`` and ``>``.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")))
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    same = np.zeros(len(codes) + 1, dtype=np.int64)
    same[2:] = np.cumsum(codes[1:] == codes[:-1]) if len(codes) > 1 else 0
    # the first word of a text has none before it
    repeats = same[bounds[1:]] - same[np.minimum(bounds[:-1] + 1, bounds[1:])]
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    n = len(lengths)
    joined = pc.binary_join(pa.array([coded.dictionary], pa.list_(pa.string())), "><")[0].as_py() if n else ""
    points = np.frombuffer(("<" + joined + ">").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if not n:
        return Words(codes, bounds, repeats, np.zeros(0, np.int64), np.zeros(1, np.int64))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(n), lengths)
    place = (np.arange(ends[-1]) - starts[owner]).astype(np.uint64)
    hashes = [_mix(np.add.reduceat(_mix(points + (place << np.uint64(21))), starts))]
    owners = [np.arange(n)]
    rolled = points.copy()
    for size in range(2, settings.longest + 1):
        rolled = _mix(rolled[:-1] * np.uint64(0x100000001B3) + points[size - 1:])
        if size >= settings.shortest:
            inside = np.arange(len(rolled)) + size <= ends[owner[:len(rolled)]]
            hashes.append(rolled[inside] + np.uint64(size))
            owners.append(owner[:len(rolled)][inside])
    whose, every = np.concatenate(owners), np.concatenate(hashes)
    word = lengths[whose] > 2  # a blank text splits into one empty word, which has no vector
    whose, every = whose[word], every[word]
    order = np.argsort(whose, kind="stable")
    buckets = (every % np.uint64(settings.buckets)).astype(np.int64)[order]
    return Words(codes, bounds, repeats, buckets, np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]))


def bags(texts: pa.Array, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their counts; the end mark of every text
    gives the empty text a bag."""
    found = words_of(texts, settings)
    out = []
    for a, b, again in zip(found.bounds, found.bounds[1:], found.repeats):
        own, times = np.unique(found.codes[a:b], return_counts=True)
        sizes = found.reach[own + 1] - found.reach[own]
        at = np.repeat(found.reach[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        every = np.concatenate([[_END, _AGAIN], found.buckets[at]])
        names, place = np.unique(every, return_inverse=True)
        weight = np.concatenate([[1, again], np.repeat(times, sizes)])
        out.append((names.astype(np.int32), np.bincount(place, weights=weight).astype(np.float32)))
    return out


@dataclass
class Model:
    vectors: np.ndarray
    outputs: np.ndarray
    settings: Settings

    def probabilities(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The softmax over a text's averaged vector."""
        scores = self.outputs @ ((counts / counts.sum()) @ self.vectors[buckets])
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()

    def per_bucket(self) -> np.ndarray:
        """Each bucket's part of the difference between the two outputs."""
        return (self.vectors @ (self.outputs[1] - self.outputs[0])).astype(np.float64)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], settings: Settings) -> Model:
    """Softmax on averaged vectors by gradient steps of one text each, at a falling rate.

    Steps are weighted so that both labels count alike, and normalised by the text's bag, so
    a long text does not learn more slowly. Without rows every score is one half.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = (rng.random((settings.buckets, settings.dim), dtype=np.float32) - 0.5) * (2 / settings.dim)
    outputs = (rng.random((2, settings.dim), dtype=np.float32) - 0.5) * bool(rows)
    model = Model(vectors, outputs, settings)
    n = len(rows)
    share = np.bincount(labels, minlength=2) / max(n, 1)
    weight = np.minimum(0.5 / np.maximum(share, 1e-9), 4.0)
    parts = [(b, c / c.sum()) for b, c in rows]
    done = 0
    for _ in range(settings.epochs):
        for i in rng.permutation(n):
            buckets, part = parts[i]
            rate = settings.rate * (1 - done / (settings.epochs * n)) * weight[labels[i]]
            own = vectors[buckets]
            hidden = part @ own
            scores = outputs @ hidden
            wrong = np.exp(scores - scores.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            back = wrong @ outputs
            outputs -= np.float32(rate) * np.outer(wrong, hidden)
            vectors[buckets] = own - np.outer(part * np.float32(rate / (part @ part)), back)
            done += 1
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, label_col: str,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bounded, repeatable sample of labelled texts, away from the held-out fold.

    The sample is the rows with the least hashes of their id. A row labelled twice has its
    larger label; other labels than 0 and 1 and rows without id or label are left out.
    """
    named = labels.select(F.col(id_col).cast("bigint").alias("doc_id"),
                          F.col(label_col).cast("int").alias("label")) \
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    # at most ``sample`` rows of two numbers; of rows that share an id one text is learned from
    return keyed_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id") \
        .groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
        label_col: str = "quality") -> Model:
    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        found = bags(part.column("text"), settings)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("label"),
             pa.array([b.tobytes() for b, _ in found], pa.binary()),
             pa.array([c.tobytes() for _, c in found], pa.binary())],
            names=["doc_id", "label", "buckets", "counts"])

    rows = training_rows(docs, labels, settings, label_col).select("doc_id", "label", "text")
    got = map_texts(rows, "doc_id long, label int, buckets binary, counts binary", look).collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"]), bytes(r["counts"])))
    return train([(np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["counts"], dtype=np.float32))
                  for r in got], [r["label"] for r in got], settings)


def scores(texts: pa.Array, per_bucket: np.ndarray, settings: Settings) -> np.ndarray:
    """The chance of label 1 of each text, from all its words."""
    found = words_of(texts, settings)
    sums = np.concatenate([[0.0], np.cumsum(per_bucket[found.buckets])])
    worth = sums[found.reach[1:]] - sums[found.reach[:-1]]
    sizes = np.diff(found.reach)
    total = np.concatenate([[0.0], np.cumsum(worth[found.codes])])
    count = np.concatenate([[0], np.cumsum(sizes[found.codes])])
    a, b = found.bounds[:-1], found.bounds[1:]
    total = total[b] - total[a] + per_bucket[_END] + per_bucket[_AGAIN] * found.repeats
    mean = total / (count[b] - count[a] + 1 + found.repeats)
    return 1 / (1 + np.exp(-np.clip(mean, -500, 500)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the chance of label 1, of every row; whole texts, no shuffle.

    Null and empty texts are scored by the end mark alone; repeated rows stay.
    """
    settings = model.settings
    shared = docs.sparkSession.sparkContext.broadcast(model.per_bucket())  # one number a bucket

    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(scores(part.column("text"), shared.value, settings))],
            names=["doc_id", "score"])

    return map_texts(keyed_text(docs, id_col, text_col), "doc_id long, score double", look)
