"""Quality rules on repetition, from suffix arrays over words.

The suffixes of a step's texts are sorted together by prefix doubling: after round k they
are ranked by their first 2^k words, and only suffixes that still share a rank go on, so
ordinary prose is done after two or three rounds. The ranks of all rounds give the longest
common prefix of neighbouring suffixes. The deepest interval of common prefixes around a
suffix, the larger of its two neighbouring values, is the longest repeat that begins there;
the union of those spans is the union of all maximal repeated substrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_text, map_texts, steps, utf8

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, "
          "kept boolean")


@dataclass(frozen=True)
class Limits:
    """A text is kept while its repeats stay below these.

    ``shortest`` is the least length in words of a repeat that counts; the counted repeats
    may cover ``covered`` of the words, and none may be longer than ``longest`` words or,
    in long texts, ``longest_share`` of the words.
    """
    min_words: int = 50
    base_repeat_percent: int = 50
    shortest: int = 10
    covered: float = 0.3
    longest: int = 60
    longest_share: float = 0.25


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... symbols; the last list entry has every suffix apart.

    ``ends[i]`` is the end of the text that position i belongs to; symbols of different
    texts must differ in order only through their text, so suffixes never tie across texts.
    """
    n = len(symbols)
    order = np.lexsort((symbols, ends))
    key_a, key_b = ends[order], symbols[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])
    rank = np.empty(n, dtype=np.int64)
    heads = np.flatnonzero(new)
    rank[order] = heads[np.cumsum(new) - 1]
    ranks = [rank]
    open_ = order[~(new & np.append(new[1:], True))]
    h = 1
    while len(open_):
        rank = ranks[-1]
        ahead = open_ + h
        inside = ahead < ends[open_]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[open_]
        sub = np.lexsort((second, first))
        open_, first, second = open_[sub], first[sub], second[sub]
        group = np.ones(len(open_), dtype=bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(open_))
        place = at - np.maximum.accumulate(np.where(group, at, 0))
        # a subgroup's rank: its group's rank plus the place of its first member
        lead = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[open_] = first + place[lead]
        ranks.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return ranks


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that its text repeats."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ranks = suffix_ranks(symbols, ends)
    array = np.empty(n, dtype=np.int64)
    array[ranks[-1]] = np.arange(n)
    a, b = array[:-1], array[1:]
    same = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b = a[same], b[same]
    common = np.zeros(len(same), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        equal = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        common += equal.astype(np.int64) << k
    best = np.zeros(n, dtype=np.int64)
    best[a] = common  # a suffix has one neighbour on either side
    best[b] = np.maximum(best[b], common)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Marks of the positions inside a repeat of ``least`` symbols or more."""
    n = len(best)
    starts = np.flatnonzero(best >= least)
    change = np.zeros(n + 1, dtype=np.int64)
    change[starts] = 1
    change -= np.bincount(starts + best[starts], minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def maximal_repeats(words: list, least: int = 1) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of repeated words in one text, for reports."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    symbols = np.array([codes[w] for w in words], dtype=np.int64)
    best = longest_repeats(symbols, np.full(len(words), len(words)))
    return [(i, i + int(m)) for i, m in enumerate(best) if m >= least and
            (i == 0 or best[i - 1] != m + 1)]


def measure(texts: list[bytes | None], limits: Limits) -> dict[str, list]:
    """Counts of each text; all its words are read."""
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for text in split for w in text]
    codes = {w: i for i, w in enumerate(set(words))}
    symbols = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    best = longest_repeats(symbols, np.repeat(bounds[1:], sizes))
    sums = {least: np.concatenate([[0], np.cumsum(covered(best, least))])
            for least in (3, limits.shortest)}
    repeat_words = sums[3][bounds[1:]] - sums[3][bounds[:-1]]
    cover_words = sums[limits.shortest][bounds[1:]] - sums[limits.shortest][bounds[:-1]]
    longest = np.zeros(len(texts), dtype=np.int64)
    some = sizes > 0
    if len(best):
        longest[some] = np.maximum.reduceat(best, bounds[:-1][some])
    failed = (sizes < limits.min_words) | (100 * repeat_words > limits.base_repeat_percent * sizes)
    allowed = np.maximum(limits.longest, limits.longest_share * sizes)
    kept = ~failed & (cover_words <= limits.covered * sizes) & (longest <= allowed)
    return {"n_words": sizes, "word_chars": [_word_chars(t) for t in texts],
            "n_symbols": [len(t) - len(t.translate(None, _SYMBOLS)) if t else 0 for t in texts],
            "n_dup_lines": [_dup_lines(t) for t in texts], "n_repeat_words": repeat_words,
            "n_covered_words": cover_words, "longest_repeat": longest, "base_failed": failed,
            "kept": kept}


def _word_chars(text: bytes | None) -> int:
    return len(text.translate(None, _BLANKS).decode("utf-8")) if text else 0


def _dup_lines(text: bytes | None) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)] if text else []
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row; no shuffle, a row's result depends on its text alone.

    Null and empty texts have zero counts and fail the base rule; repeated rows stay.
    """
    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(utf8(part, "text"), limits)
        kinds = {"base_failed": pa.bool_(), "kept": pa.bool_()}
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items())],
            names=["doc_id", *found])

    return map_texts(keyed_text(docs, id_col, text_col), SCHEMA, look)


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; works on the rows where they lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text_col):
                yield part.filter(pa.array(measure(utf8(part, text_col), limits)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
