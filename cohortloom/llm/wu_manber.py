"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's windows of ``size`` consecutive words. A table over
blocks of two words tells how far the search may jump: a block that no pattern holds moves
it past the block, so a clean text is probed about every ninth word. Where the block ends
a pattern, the bucket of that block names the candidates and a direct comparison of all
words decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import keyed_text, map_texts, steps, utf8

#: Byte table: A-Z to lower case, every ASCII character but letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32
              for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: letters, digits and every non-ASCII character."""
    return text.translate(_FOLD).split() if text else []


class Searcher:
    """Shift and bucket tables of the patterns, one pair for each pattern length."""

    def __init__(self, patterns: Iterable[tuple[tuple[bytes, ...], tuple[str, ...]]]):
        by_length: dict[int, dict] = {}
        for words, items in patterns:
            by_length.setdefault(len(words), {})[words] = items
        self.tables = []
        for m, found in sorted(by_length.items()):
            block = min(2, m)
            shift: dict[bytes, int] = {}
            bucket: dict[bytes, dict] = {}
            for words, items in found.items():
                for end in range(block, m + 1):
                    key = b" ".join(words[end - block:end])
                    shift[key] = min(shift.get(key, m), m - end)
                bucket.setdefault(b" ".join(words[-block:]), {})[words] = items
            self.tables.append((m, block, m - block + 1, shift, bucket))

    def spans(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of every occurrence."""
        out = []
        n = len(words)
        for m, block, jump, shift, bucket in self.tables:
            end = m
            far = shift.get
            while end <= n:
                key = words[end - 1] if block == 1 else words[end - 2] + b" " + words[end - 1]
                step = far(key, jump)
                if step:
                    end += step
                    continue
                items = bucket[key].get(tuple(words[end - m:end]))
                if items is not None:
                    out.append((end - m, end, items))
                end += 1
        return out


def windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows (words joined by a space) with the items that hold them.

    A shorter item is one window; an item without words has none. The windows of an item
    without id are searched like all others and add nothing to the list of items.
    """
    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        seen = []
        for item, text in zip(part.column("item").to_pylist(), utf8(part, "text")):
            words = words_of(text)
            if words:
                seen += [(b" ".join(words[i:i + size]).decode(), item)
                         for i in range(max(1, len(words) - size + 1))]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.string())],
            names=["window", "item"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_texts(items, "window string, item string", cut) \
        .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  slice_windows: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids whose windows occur).

    The pattern tables are broadcast in slices of at most ``slice_windows`` windows, so
    their size has a bound whatever the benchmark's; with more than one slice the texts
    are read once per slice and the hit spans of a row are united. No text or item is cut.

    Null or wordless texts have no words and no hits; items without words match nothing,
    those without id hit words but are not listed; an empty benchmark gives rows without hits; repeated rows stay separate.
    """
    slices = _slices(windows(benchmark, size, item_col, item_text), slice_windows)
    source = keyed_text(docs, id_col, text_col)
    if len(slices) == 1:
        return _search(source, slices[0].collect(), keep_spans=False)
    # numbered once: every slice must see the same row under the same number
    source = written(source.withColumn("row_mark", F.monotonically_increasing_id()), "decontamination-texts")
    parts = [_search(source, part.collect(), keep_spans=True) for part in slices]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    whole = every.groupBy("row_mark").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"])))
            .alias("n"), F.greatest(a["end"], s["stop"]).alias("end")), lambda a: a["n"])
    return whole.select("doc_id", "n_words", covered.alias("n_hit"), "items")


def _slices(patterns: DataFrame, slice_windows: int) -> list[DataFrame]:
    """The patterns in parts that are each small enough to collect and broadcast."""
    n = max(1, -(-patterns.count() // slice_windows))
    return [patterns.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)]


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", slice_windows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark window occurs; no shuffle.

    Null and empty texts stay, also repeated rows; an empty benchmark keeps every row.
    """
    for part in _slices(windows(benchmark, size, item_col, item_text), slice_windows):
        docs = _without(docs, part.collect(), text_col)
    return docs


def _without(docs: DataFrame, patterns: list, text_col: str) -> DataFrame:
    shared = _shared(docs, patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher((tuple(w.encode().split(b" ")), i) for w, i in shared.value)
        for batch in batches:
            for part in steps(batch, text_col):
                yield part.filter(pa.array([not searcher.spans(words_of(t)) for t in utf8(part, text_col)],
                                           pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _shared(docs: DataFrame, patterns: list):
    return docs.sparkSession.sparkContext.broadcast([(p["window"], tuple(p["items"])) for p in patterns])


def _search(source: DataFrame, patterns: list, keep_spans: bool) -> DataFrame:
    shared = _shared(source, patterns)
    searcher: list[Searcher] = []
    extra = ["row_mark"] if keep_spans else []
    schema = "doc_id long, n_words long, " + ("row_mark long, spans array<struct<start:long,stop:long>>, "
                                              if keep_spans else "n_hit long, ") + "items array<string>"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        if not searcher:
            searcher.append(Searcher((tuple(w.encode().split(b" ")), i) for w, i in shared.value))
        n_words, n_hit, items, spans = [], [], [], []
        for text in utf8(part, "text"):
            words = words_of(text)
            found = searcher[0].spans(words)
            n_words.append(len(words))
            items.append(sorted({i for _, _, names in found for i in names}))
            if keep_spans:
                spans.append([{"start": a, "stop": b} for a, b, _ in found])
            else:
                hit, reach = 0, 0
                for a, b, _ in sorted(found):
                    hit += max(0, b - max(a, reach))
                    reach = max(reach, b)
                n_hit.append(hit)
        made = [part.column("doc_id"), pa.array(n_words, pa.int64())]
        made += [part.column("row_mark"), pa.array(spans, span_type)] if keep_spans \
            else [pa.array(n_hit, pa.int64())]
        names = ["doc_id", "n_words", *(["row_mark", "spans"] if keep_spans else ["n_hit"]), "items"]
        return pa.RecordBatch.from_arrays([*made, pa.array(items, pa.list_(pa.string()))], names=names)

    return map_texts(source.select("doc_id", "text", *extra), schema, look)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
