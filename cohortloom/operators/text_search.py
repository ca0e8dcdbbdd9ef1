"""Text search over an inverted index with positions.

``build`` writes one posting per word and document: the word, how often it stands there and
at which places, beside the document's length. Postings lie in sampled ranges of (word,
document), so a search reads only the row groups of its words, a beginning of a word is one
range of them, and a word that most documents hold is spread over many files. Words of a
document are grouped before anything is shuffled. A search never sees a body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import B, K1, TOKEN, Term, folded, query_terms


class TextIndex(NamedTuple):
    """``postings``: term, row, doc_id, dl, tf, positions. ``totals``: one row n_docs, mean_dl."""

    postings: DataFrame
    totals: DataFrame
    id_column: str


#: Words that are grouped at once; a longer document is grouped by itself.
WORDS = 1 << 18


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents with at most WORDS words, or one document."""
    for batch in batches:
        bounds = batch.column("words").offsets.to_numpy().astype(np.int64)
        start = 0
        while start < len(batch):
            end = int(np.searchsorted(bounds, bounds[start] + WORDS, side="right")) - 1
            end = min(max(end, start + 1), len(batch))
            yield batch.slice(start, end - start)
            start = end


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each document as postings; whole columns of a few documents at a time."""
    for batch in _pieces(batches):
        lists = batch.column("words")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(bounds)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(batch)), sizes)
        place = np.arange(len(codes)) - np.repeat(bounds[:-1] - bounds[0], sizes)
        order = np.lexsort((place, codes, owner))
        codes, owner, place = codes[order], owner[order], place[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first, len(codes)).astype(np.int32)
        rows = pa.array(owner[first])
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(codes[first])), batch.column("row").take(rows),
             batch.column("doc").take(rows), pa.array(sizes[owner[first]].astype(np.int32)),
             pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))],
            names=["term", "row", "doc", "dl", "tf", "positions"])


def build(documents: DataFrame, id_column: str = "doc_id", text_column: str = "full_text") -> TextIndex:
    """The index of all documents, written once in the session's folder.

    Null texts have no words; they count as documents. Repeated ids stay documents of their own.
    """
    numbered = written(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc"),
        F.regexp_extract_all(folded(F.coalesce(F.col(text_column), F.lit(""))), F.lit(TOKEN), F.lit(0))
        .alias("words")), "search-words")
    kind = numbered.schema["doc"].dataType.simpleString()
    postings = numbered.filter(F.size("words") > 0).mapInArrow(
        _grouped, f"term string, row long, doc {kind}, dl int, tf int, positions array<int>")
    laid = postings.repartitionByRange("term", "row").sortWithinPartitions("term", "row")
    totals = numbered.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean_dl"))
    return TextIndex(written(laid, "search-postings").withColumnRenamed("doc", id_column),
                     written(totals, "search-totals"), id_column)


def _clauses(text: str) -> list[list[Term]]:
    """The terms of a query between its ORs; each clause needs all of its own."""
    parts = re.split(r"\s+OR\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", text.strip())
    clauses = [query_terms(part) for part in parts]
    if any(all(t.banned for t in clause) for clause in clauses):
        raise ValueError("the query, or a part between ORs, holds no term")
    return clauses


def _matches(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def _shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def bm25(index: TextIndex, text: str) -> DataFrame:
    """BM25 of documents that a query fits; lower is better, as the score is negated.

    A query is words, "phrases", beginnings* and -excluded ones, all of which must hold;
    OR between such parts asks for any of them. Only postings of the query's words are read;
    they meet once per document, and a phrase is the intersection of its words' places.
    """
    clauses = _clauses(text)
    terms = list(dict.fromkeys(t for clause in clauses for t in clause))
    asked = sorted({(w, t.prefix and w is t.words[-1]) for t in terms for w in t.words})
    read = index.postings.filter(reduce(Column.__or__, [_matches(w, p) for w, p in asked]))
    phrases = [t for t in terms if len(t.words) > 1]
    columns = [F.sum(F.when(_matches(t.words[0], t.prefix), F.col("tf")).otherwise(0)).alias(f"tf_{i}")
               for i, t in enumerate(terms) if len(t.words) == 1]
    listed = sorted({w for t in phrases for w in t.words})
    columns += [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"at_{k}") for k, w in enumerate(listed)]
    met = read.groupBy("row", index.id_column, "dl").agg(*columns)
    for i, t in enumerate(terms):
        if len(t.words) > 1:
            # the places at which the first word would have to stand, for each word
            starts = [_shifted(F.coalesce(F.col(f"at_{listed.index(w)}"), F.array().cast("array<int>")), k)
                      for k, w in enumerate(t.words)]
            met = met.withColumn(f"tf_{i}", F.size(reduce(F.array_intersect, starts)).cast("bigint"))
    tf = {t: F.col(f"tf_{i}") for i, t in enumerate(terms)}
    wanted = [t for t in terms if any(t in clause and not t.banned for clause in clauses)]
    counted = met.agg(*[F.count_if(tf[t] > 0).alias(f"df_{i}") for i, t in enumerate(terms)]) \
        .crossJoin(index.totals)  # one row each
    fits = reduce(Column.__or__, [reduce(Column.__and__, [
        tf[t] == 0 if t.banned else tf[t] > 0 for t in clause]) for clause in clauses])
    scored = met.filter(fits).crossJoin(F.broadcast(counted))  # one row of statistics
    total = F.lit(0.0)
    for t in wanted:
        df = F.col(f"df_{terms.index(t)}")
        idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        total = total + idf * (tf[t] * (K1 + 1)) / (
            tf[t] + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    return scored.select(index.id_column, (-total).alias("score"))
