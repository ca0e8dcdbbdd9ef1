"""The inverted index, long prose and what a session keeps, against plain versions."""

import re
import time
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text
from cohortloom.operators import retrieval, text_search
from cohortloom.sources import scratch

BODIES = ["The MIT License, and the mit license again", "mit, then a license", None, "", "Élan élan elan; de la de la",
          "apache version two", "the the the", "de la mit license", "elantra de  la", "version of apache. the end",
          "naïve mit-license", "the"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i if i < 11 else 1, b) for i, b in enumerate(BODIES)]
    return text_search.build(spark.createDataFrame(rows, "doc_id long, full_text string"))


def plain_bm25(clauses):
    """clauses: lists of (words, prefix, banned); rows (position in BODIES, score)."""
    docs = [re.findall(r"[^\W_]+", retrieval.plain(b or "")) for b in BODIES]
    terms = list(dict.fromkeys(t for c in clauses for t in c))

    def count(words, prefix, tokens):
        return sum(all(tokens[i + k].startswith(w) if prefix else tokens[i + k] == w for k, w in enumerate(words))
                   for i in range(len(tokens) - len(words) + 1))
    tf = {t: [count(t[0], t[1], d) for d in docs] for t in terms}
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for i, d in enumerate(docs):
        if not any(all((tf[t][i] == 0) if t[2] else (tf[t][i] > 0) for t in c) for c in clauses):
            continue
        score = 0.0
        for t in terms:
            if not t[2]:
                df = sum(n > 0 for n in tf[t])
                idf = log((len(docs) - df + 0.5) / (df + 0.5))
                score += (idf if idf > 0 else 1e-6) * tf[t][i] * 2.2 / (tf[t][i] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append((i if i < 11 else 1, round(-score, 9)))
    return sorted(out)


@pytest.mark.parametrize("query,clauses", [
    ("the", [[(("the",), False, False)]]),
    ("mit LICENSE", [[(("mit",), False, False), (("license",), False, False)]]),
    ('"mit license"', [[(("mit", "license"), False, False)]]),
    ('"de la" elan*', [[(("de", "la"), False, False), (("elan",), True, False)]]),
    ("élan -mit", [[(("elan",), False, False), (("mit",), False, True)]]),
    ('"mit license" OR apache version OR the -mit', [[(("mit", "license"), False, False)], [
        (("apache",), False, False), (("version",), False, False)], [(("the",), False, False), (("mit",), False, True)]]),
    ("nowhere", [[(("nowhere",), False, False)]]),
])
def test_search(index, query, clauses):
    got = sorted((r["doc_id"], round(r["score"], 9)) for r in text_search.bm25(index, query).collect())
    assert got == plain_bm25(clauses)


def test_search_reads_only_its_words(spark, index):
    plan = text_search.bm25(index, 'apache "mit license"')._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [apache,license,mit])" in plan.replace(", ", ",").replace("In(term,[", "In(term, [") or \
        plan.count("EqualTo(term,") >= 3
    assert "full_text" not in plan and "words" not in plan
    with pytest.raises(ValueError):
        text_search.bm25(index, "a OR -b")
    nothing = text_search.build(spark.createDataFrame([], "doc_id long, full_text string"))
    assert text_search.bm25(nothing, "the").count() == 0


def test_long_prose_is_linear(spark):
    patterns = [text.phrase_pattern(p) for p in ("oral ulceration", "oral", "rash")]
    seconds = {}
    for n in (2_000, 40_000):
        body = "word oral  ulceration rash, of-oral. Another oral here! " * (n // 8)
        df = spark.createDataFrame([(body,)], "t string").repartition(1).select(
            F.expr(text.hits("t", patterns, "h")).alias("h"), F.expr(text.sentences("t")).alias("s"))
        row = df.first()
        want = [(m.start(), m.start() + len(m[1]), " ".join(m[1].split()))
                for m in re.finditer(r"\b(?=(oral\s+ulceration|oral|rash)\b)", body)]
        assert [tuple(h) for h in row["h"]] == want
        assert all(body[s["s"]:s["e"]] == s["text"] for s in row["s"]) and len(row["s"]) == n // 8 + 1
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds[n] = time.perf_counter() - began
    assert seconds[40_000] < 20 * 4 * max(seconds[2_000], 0.1)


def test_session_keeps_by_inputs(spark, tmp_path):
    path, made = str(tmp_path / "t"), Counter()

    def make():
        made["n"] += 1
        return made["n"]
    spark.range(3).write.parquet(path)
    assert [scratch.once(spark, "x", [path], make) for _ in range(3)] == [1, 1, 1]
    assert scratch.once(spark, "y", [path], make) == 2
    spark.range(1).write.mode("append").parquet(path)
    assert scratch.once(spark, "x", [path], make) == 3
    assert scratch.stamp(spark, [str(tmp_path / "none")]) == ()


def test_builders_are_quick_once_warm(spark):
    from cohortloom.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    for name in ("structured_incidence", "mention_table"):
        QUERIES[name](spark, sf)
        began = time.perf_counter()
        QUERIES[name](spark, sf)
        assert time.perf_counter() - began < 3


def test_words_are_grouped_a_few_documents_at_a_time(monkeypatch):
    """However many documents a batch holds, one step takes a bounded number of words."""
    import pyarrow as pa
    from cohortloom.operators import text_search
    words = [["a", "b", "a"], [], ["c"] * 9, ["a"], ["b", "b"], []]
    batch = pa.RecordBatch.from_pydict({"row": list(range(6)), "doc": list(range(10, 16)), "words": words})
    whole = [b.to_pylist() for b in text_search._grouped(iter([batch]))]
    monkeypatch.setattr(text_search, "WORDS", 4)
    parts = [b.to_pylist() for b in text_search._grouped(iter([batch.slice(0, 3), batch.slice(3)]))]
    assert sum(parts, []) == sum(whole, [])
    assert len(whole) == 1 and all(sum(r["tf"] for r in p) <= 4 or len({r["row"] for r in p}) == 1 for p in parts)
