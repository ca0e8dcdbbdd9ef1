"""License notices in texts: an exact set-similarity join of text blocks with templates.

Templates and blocks are sets of words. A block matches a template if it holds at least
``threshold`` of the template's words. For templates of up to m words, rounded up to a
power of two, blocks are runs of 2 m words that begin at every multiple of m, so a notice
of up to m words lies whole in a block wherever it stands and however its lines break.

Words are ordered by the number of documents that hold them, rarest first. A template of
which r words are required must share one of its first (size - r + 1) words with a block
(prefix filter); a block must hold r words of some template (length filter); from the
first shared word on, both must have r words left (positional filter). Only blocks with a
prefix word are formed at all. What passes is confirmed by the size of the whole
intersection, so the result is that of comparing every block with every template. Only
DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import lower_ascii

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The notices looked for, as their licenses word them, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the "
               "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all "
            "copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
]

#: Part of a template's words that a block must hold.
THRESHOLD = 0.9
#: Distinct words of all templates together: they travel with the plan, so they have a bound.
MOST_WORDS = 20_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: letters, digits and every non-ASCII character."""
    return F.array_remove(F.split(lower_ascii(text), _GAP, -1), "")


def word_list(text: str) -> list[str]:
    """``words`` of a template, on the driver."""
    folded = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(_GAP, folded) if w]


def strings(values: list[str]) -> Column:
    return F.lit(values) if values else F.array().cast("array<string>")


def places(held: Column, phrases: list[list[str]]) -> Column:
    """Every position at which one of the phrases begins, by phrase and position."""
    def at(phrase: list[str]) -> Column:
        starts = F.sequence(F.lit(0), F.size(held) - len(phrase))
        stands = F.filter(starts, lambda i: reduce(
            Column.__and__, [F.get(held, i + k) == word for k, word in enumerate(phrase)]))
        # only a text that holds all words is gone through
        some = reduce(Column.__and__, [F.array_contains(held, w) for w in phrase])
        return F.when(some & (F.size(held) >= len(phrase)), stands).otherwise(F.array().cast("array<int>"))
    return F.array(*map(at, phrases))


class Templates:
    """Templates as word sets, and the order of their words once their counts are known."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.sets = []
        for label, text in templates:
            listed = word_list(text)
            if listed:
                block = 1 << max(3, (len(listed) - 1).bit_length())
                self.sets.append((label, block, sorted(set(listed)), math.ceil(threshold * len(set(listed)) - 1e-9)))
        self.vocabulary = sorted({w for *_, held, _ in self.sets for w in held})
        if len(self.vocabulary) > MOST_WORDS:
            raise ValueError(f"templates have {len(self.vocabulary)} distinct words, more than {MOST_WORDS}")

    def ordered(self, counts: dict[str, int]) -> list[str]:
        """The vocabulary by number of documents, rarest first; the word itself decides ties."""
        return sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w))

    def prefixes(self, order: list[str]) -> list[tuple]:
        """(block, word, place, template, label, words in order, required) of every prefix word."""
        rank = {w: i for i, w in enumerate(order)}
        out = []
        for number, (label, block, held, required) in enumerate(self.sets):
            inside = sorted(held, key=rank.__getitem__)
            out += [(block, w, i, number, label, inside, required)
                    for i, w in enumerate(inside[:len(inside) - required + 1])]
        return out


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """Documents, of all, that hold each word of the vocabulary."""
    held = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), strings(vocabulary))).alias("word"))
    # at most one row a word of the vocabulary
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def marks_of(held: Column, prefixes: list[tuple]) -> Column:
    """Positions of words that are some template's prefix word; null if there is none."""
    rare = sorted({p[1] for p in prefixes})
    stands = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: F.get(held, i).isin(rare))
    return F.when(F.arrays_overlap(held, strings(rare)), stands)


def blocks_of(held: Column, marks: Column, prefixes: list[tuple], order: list[str]) -> Column:
    """The blocks with a prefix word and enough template words: (block size, number, their words
    that templates hold, rarest first)."""
    out = []
    for size in sorted({p[0] for p in prefixes}):
        mine = [p for p in prefixes if p[0] == size]
        rare, least = sorted({p[1] for p in mine}), min(p[6] for p in mine)
        # a word at i lies in the block that begins at its multiple of the size and in the one before
        own = F.filter(marks, lambda i: F.get(held, i).isin(rare))
        numbers = F.array_distinct(F.flatten(F.transform(own, lambda i: F.array(
            F.greatest(F.lit(0), F.floor(i / size).cast("int") - 1), F.floor(i / size).cast("int")))))
        cut = F.transform(numbers, lambda b: F.struct(
            F.lit(size).alias("size"), b.alias("number"),
            F.array_intersect(strings(order), F.slice(held, b * size + 1, 2 * size)).alias("words")))
        out.append(F.filter(cut, lambda x: F.size(x["words"]) >= least))
    empty = F.array().cast("array<struct<size:int,number:int,words:array<string>>>")
    return F.when(marks.isNull(), empty).otherwise(F.concat(empty, *out))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
         phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches per row.

    ``labels`` are those of phrases and templates, ``score`` is 1 with a phrase, else the
    largest part of a template that a block holds (0 without a match), ``matches`` has
    (template, block size, block number, part held) of every match.

    A null or wordless text has no words and no labels. Repeated rows and rows without id
    stay separate. An empty table gives no rows. Other columns are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = known.ordered(word_counts(source, known.vocabulary, "text"))
    prefixes = known.prefixes(order)
    listed = [word_list(p) for p in phrases]
    read = source.select("doc_id", words(F.col("text")).alias("held"))
    read = read.withColumn("marks", marks_of(F.col("held"), prefixes))
    found = read.select("doc_id", F.size("held").cast("bigint").alias("n_words"),
                        places(F.col("held"), listed).alias("at"),
                        blocks_of(F.col("held"), F.col("marks"), prefixes, order).alias("blocks"))
    # no text and few blocks: a row's mark is fixed by writing it
    kept = written(found.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    matched = matches(kept, prefixes).groupBy("row").agg(
        F.array_sort(F.collect_set("label")).alias("found"), F.max("part").alias("part"),
        F.array_sort(F.collect_list(F.struct("template", "size", "number", "part"))).alias("matches"))
    every = F.flatten("at")
    base = F.array_sort(F.array_distinct(F.filter(F.array(
        *[F.when(F.size(F.get("at", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]),
        lambda x: x.isNotNull())))
    met = kept.select("row", "doc_id", "n_words", F.size(every).cast("bigint").alias("n_base"),
                      F.array_min(every).cast("bigint").alias("first_word"),
                      F.array_max(every).cast("bigint").alias("last_word"), base.alias("base")).join(
        matched, "row", "left")
    none = F.array().cast("array<string>")
    return met.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
        F.coalesce("matches", F.array().cast(met.schema["matches"].dataType)).alias("matches"))


def matches(kept: DataFrame, prefixes: list[tuple]) -> DataFrame:
    """(row, size, number, template, label, part) of every block and template that match."""
    index = kept.sparkSession.createDataFrame(
        prefixes, "size int, word string, i int, template int, label string, wanted array<string>, required int")
    blocks = kept.select("row", F.inline("blocks")).withColumnRenamed("words", "own")
    seen = blocks.select("row", "size", "number", "own", F.posexplode("own").alias("j", "word"))
    # the index has at most MOST_WORDS words and goes to every task
    pairs = seen.join(F.broadcast(index), ["size", "word"])
    left = F.least(F.size("own") - F.col("j"), F.size("wanted") - F.col("i"))
    passed = pairs.filter((F.size("own") >= F.col("required")) & (left >= F.col("required")))
    shared = F.size(F.array_intersect("own", "wanted"))
    confirmed = passed.withColumn("shared", shared).filter(F.col("shared") >= F.col("required"))
    return confirmed.select("row", "size", "number", "template", "label",
                            (F.col("shared") / F.size("wanted")).alias("part")).distinct()
