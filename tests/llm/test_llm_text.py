"""Readers of single texts: token ids, repetition, extraction, contamination, classifier."""

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from cohortloom.llm import packed_ids, subword_classifier, suffix_rules, tree_extract, units, wu_manber
from cohortloom.llm.common import table
from cohortloom.llm.queries import QUERIES, vocabulary
from llm_fixtures import SF, awkward, nothing, workers_reach_the_package  # noqa: F401


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_library_ids(name):
    coder = units.Encoder(vocabulary(name))
    odd = ["", " ", "  a b", "a\n\nb ", "\t\tfoo bar\n", "don't 'll  've", "a\x1cb c", "<|endoftext|> x", "ΣAΣ Σ",
           "x\r\ny", "日本 語", "wide　space", "İ, é.", "a\x01b \x01 c", "é ́x", None]
    odd += [f"a{chr(c)}, {chr(c)}b {chr(c)}{chr(c)}." for c in range(0x20, 0x2100, 7)]
    odd += ["<|startoftext|>a<|endoftext|>", "<|StartOfText|> b", "<| c", "a  <|endoftext|>\u3000d"]
    plain = Tokenizer.from_file(vocabulary(name))
    for text, ids in zip(odd, coder.encode(pa.array(odd, pa.string()), 1).to_pylist()):
        assert np.frombuffer(ids, coder.kind).tolist() == \
            [*plain.encode(text or "", add_special_tokens=False).ids, 1], text
    assert coder.single and len(coder.encode(pa.array([], pa.string()), 1)) == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\tab1É.,'K%́x")), max_size=20), max_size=6))
def test_units_on_any_text(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder = units.encoder(vocabulary(name))
        got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(pa.array(texts, pa.string())).to_pylist()]
        assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 5, 15, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 64 * 37, dtype=np.uint64).astype("<u4")
    data = packed_ids.pack(ids, bits)
    assert len(data) == len(ids) * bits // 8 and (packed_ids.unpack(data, bits) == ids).all()


def test_packed_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 49_408, n).astype("<u4"))
            for i, n in enumerate([0, 1, 8191, 8192, 3, 40_000, 0, 200_000])]
    with open(tmp_path / "f", "wb") as out:
        writer = packed_ids.Writer(out, packed_ids.width(49_408))
        for doc_id, ids in docs:
            writer.add(doc_id, ids.tobytes())
        writer.close()
    with open(tmp_path / "f", "rb") as file:
        reader = packed_ids.Reader(file, (tmp_path / "f").stat().st_size)
        assert reader.bits == 16 and reader.doc_ids == [d for d, _ in docs]
        for i in (5, 2, 7, 0):
            assert (reader.document(i) == docs[i][1]).all()
        assert [(d, n, c) for d, _, n, c in reader.crcs(8192)] == \
            [(d, len(x), brute.crc(x)) for d, x in docs]


def check_ids(spark, docs, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    manifest = packed_ids.write(docs, path, str(tmp_path / "ids"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                 for r in packed_ids.read_digests(manifest).collect())
    coder = Tokenizer.from_file(path)
    at, left = 0, [(d, coder.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in pairs(docs)]
    assert [g[1] for g in got] == sorted((d for d, _ in left), key=lambda d: (d is not None, d or 0))
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        left.remove(next(x for x in left if x[0] == doc_id and len(x[1]) == n and brute.crc(x[1]) == crc))
    assert not left
    return manifest


def test_packed_ids_over_tables(spark, awkward, nothing, tmp_path):
    manifest = check_ids(spark, awkward, tmp_path)
    assert packed_ids.read_ids(manifest).count() == awkward.count()
    assert packed_ids.read_digests(packed_ids.write(
        nothing, vocabulary("word_bpe_49k.json"), str(tmp_path / "none"))).count() == 0
    check_ids(spark, table(spark, SF, "documents"), tmp_path / "sf")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=5))
def test_suffix_repeats(texts):
    symbols = np.array([ord(c) for t in texts for c in t], dtype=np.int64)
    ends = np.repeat(np.cumsum([len(t) for t in texts], dtype=np.int64), [len(t) for t in texts]) \
        if texts else np.zeros(0, np.int64)
    want = [n for t in texts for n in brute.repeats(t)]
    assert suffix_rules.longest_repeats(symbols, ends).tolist() == want


def test_repetition(spark, awkward, nothing):
    for docs in (awkward, table(spark, SF, "documents")):
        got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                       r["n_repeat_words"]) for r in suffix_rules.repetition(docs).collect()), key=str)
        assert got == sorted(((d, *brute.base_counts(t)) for d, t in pairs(docs)), key=str)
    found = {r["doc_id"]: r for r in suffix_rules.repetition(awkward).collect() if r["doc_id"]}
    assert found[1]["base_failed"] and not found[1]["kept"] and found[11]["base_failed"]
    kept = suffix_rules.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in found.items() if r["kept"]}
    assert suffix_rules.repetition(nothing).count() == suffix_rules.keep_good(nothing).count() == 0
    body = [f"word{i}" for i in range(400)]
    passage = " ".join(body[:150])
    texts = {"plain": " ".join(body), "long repeat": " ".join(body) + " " + passage,
             "short repeat": " ".join(body) + " " + " ".join(body[:12])}
    verdict = dict(zip(texts, suffix_rules.measure([t.encode() for t in texts.values()],
                                                   suffix_rules.Limits())["kept"]))
    assert verdict == {"plain": True, "long repeat": False, "short repeat": True}
    assert suffix_rules.maximal_repeats("a b c x a b c y".split()) == [(0, 3), (4, 7)]


def test_contamination(spark, awkward, nothing):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    items = spark.createDataFrame([(10, " ".join(words)), (9, "Own WORDS of"), (8, None), (7, "?!"), (None, "one")],
                                  "item_id long, text string")
    texts = awkward.unionByName(awkward.limit(1).selectExpr(
        "cast(99 as long) doc_id", f"'x {' '.join(words).upper()}, y' text",
        *[c for c in awkward.columns if c not in ("doc_id", "text")]))
    for docs, bench in ((texts, items), (table(spark, SF, "documents"), table(spark, SF, "benchmark"))):
        known = [(r["item_id"], r["text"]) for r in bench.collect()]
        want = sorted(brute.contamination(pairs(docs), known), key=str)
        for limit in (1_000_000, 7 if bench is items else 500):
            got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), wu_manber.items_digest(r["items"]),
                           r["n_hit"] > 0) for r in wu_manber.contamination(
                docs, bench, slice_windows=limit).collect()), key=str)
            assert got == want
            left = wu_manber.clean(docs, bench, slice_windows=limit)
            assert sorted((r["doc_id"] for r in left.collect()), key=str) == \
                sorted((w[0] for w in want if not w[-1]), key=str)
    assert wu_manber.contamination(nothing, items).count() == 0
    assert wu_manber.contamination(awkward, items.filter("false")).filter("n_hit > 0").count() == 0


def test_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Site head</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id=main><h1>The  title</h1><p>First, a paragraph of some length, with commas, and <b>bold <i>text</b>.
    <p>Second&nbsp;paragraph &amp; more&#33; It goes on, and on, for a while.<br>After the break.
    <div class="ad">Buy now</div><table><tr><td>cell one<td>cell two</table><form><input value=x>Search</form></div>
    <aside>Side bar</aside><div class="comments"><p>First reader says, hello, there, all of you, again, and again.</p></div>
    <!-- hidden --><footer>&copy; foot</footer></body></html>"""
    assert tree_extract.extract(page) == (
        "The title First, a paragraph of some length, with commas, and bold text. Second paragraph & more! "
        "It goes on, and on, for a while. After the break. cell one cell two")
    for empty in (None, "", "<html></html>", "<nav>only menu</nav>"):
        assert tree_extract.extract(empty) == ""
    assert tree_extract.extract("no markup at all") == "no markup at all"
    rows = spark.createDataFrame([(1, "u", page, 3), (1, "u", page, 3), (2, None, None, 4), (None, "v", "<p>x", 5)],
                                 "page_id long, url string, html string, text int")
    got = tree_extract.main_text(rows).collect()
    assert len(got) == 4 and [r["n_chars"] for r in got if r["page_id"] == 2] == [0]
    assert tree_extract.main_text(rows.filter("false")).count() == 0
    deep = "<div>" * 3000 + "deep text, really" + "</div>" * 3000
    assert tree_extract.extract(deep) == "deep text, really"


def test_extraction_is_linear():
    """A megabyte of tags, quotes or comments that are never closed, and of ends without a start."""
    n = 1_000_000
    for unit, tail in (("<a ", ""), ("<a ", ">"), ('<a b="', ""), ('<a b="', '">'), ("<p '", ">"), ("<!-- ", ""),
                       ("<!", ""), ("</a ", ""), ("<", ">"), ("<script>", ""), ('<i x="y>', "<p>end.")):
        began = time.process_time()
        tree_extract.extract(unit * (n // len(unit)) + tail)
        assert time.process_time() - began < 20, unit
    for first, second in (("<div>", "</p>"), ("<b>", "</i>"), ("<i><div>" + "<b>", "</i>"), ("<div>", "<td>"),
                          ("<li><b>", "</li>"), ("<div>some words, and more ", "</div>")):
        began = time.process_time()
        half = n // 4
        tree_extract.extract(first * (half // len(first)) + second * (half // len(second)))
        assert time.process_time() - began < 40, first
    assert tree_extract.extract('<p>One, two.</p><a b="x><p>Three, four.</p>') == "One, two. Three, four."
    assert tree_extract.extract('<p title="a > b <i>">One, two.</p><p>1 < 2</p>') == "One, two. 1 < 2"


def test_extraction_of_other_page_shapes():
    """Headings and leads beside an article, text in cousins, articles in forms and furniture."""
    def p(k, n=300):
        return f"Paragraph {k}, " + "word, " * (n // 6) + "end."

    def tagged(*ks):
        return "".join(f"<p>{p(k)}</p>" for k in ks)

    def plain(*ks):
        return " ".join(p(k) for k in ks)

    def extract(body):
        return tree_extract.extract(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>foot</footer></body></html>")

    beside = f"<main><h1>Heading</h1><p>A lead.</p><article>{tagged(1, 2)}</article></main>"
    assert extract(beside) == f"Heading A lead. {plain(1, 2)}"
    assert extract(beside.replace("main", "div")) == f"Heading A lead. {plain(1, 2)}"
    two = "".join(f"<section><div>{tagged(*ks)}</div></section>" for ks in ((1, 2, 3), (4, 5, 6)))
    for outer in ("main", "div", "article"):
        assert extract(f"<{outer}>{two}</{outer}>") == plain(1, 2, 3, 4, 5, 6)
    assert extract(f"<main><h1>Top</h1>{two}<section><div><p>Last one, short.</p></div></section></main>") == \
        f"Top {plain(1, 2, 3, 4, 5, 6)} Last one, short."
    links = "".join(f"<li><a href=/{k}>{p(k, 60)}</a></li>" for k in range(20))
    assert extract(f"<div>{two}<ul>{links}</ul></div>") == plain(1, 2, 3, 4, 5, 6)
    assert extract(f"<div><div><div><div><div><div>{two}</div></div></div></div></div></div>") == plain(1, 2, 3, 4, 5, 6)
    for head in ("<form id=aspnetForm action=x>", "<form action=/search><input name=q>", "<div class='header-wrap widget'>",
                 "<div class='overlay'>", "<div class='page sidebar-right'>"):
        close = "</form>" if "aspnet" in head else "</div>" if "div" in head else ""
        assert extract(f"{head}<div><article>{tagged(1, 2)}</article></div>{close}") == plain(1, 2)
        assert extract(f"{head}<div>{tagged(1, 2, 3)}</div>{close}") == plain(1, 2, 3)
    # what is furniture stays out, however long
    comments = f"<div class=comments><article>{tagged(7, 8, 9)}</article></div>"
    for body in (f"<article>{tagged(1)}</article>{comments}", f"<form><article>{tagged(1)}</article>{comments}</form>"):
        assert extract(body) == p(1)


def test_extraction_of_articles(spark):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in QUERIES["op5_tree_scoring"](spark, SF).collect():
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert r["text"] == " ".join(html.unescape(plain).split())


def test_contamination_numbers_rows_once(spark):
    """Rows that change their order between reads keep their hits."""
    def shuffled(batches):
        import random
        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(pa.array(order))

    items = spark.createDataFrame([(i, f"word{i} own{i}") for i in range(6)], "item_id long, text string")
    docs = spark.range(60, numPartitions=4).selectExpr(
        "id as doc_id", "concat('word', id % 6, ' own', id % 6) as text")
    docs = docs.mapInArrow(shuffled, docs.schema)
    for r in wu_manber.contamination(docs, items, slice_windows=1).collect():
        assert (r["n_hit"], list(r["items"])) == (2, [str(r["doc_id"] % 6)])


def test_classifier(spark, awkward, nothing):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op4_subword_classifier"](spark, sf).collect()]
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    small = subword_classifier.Settings(sample=50, epochs=2)
    model = subword_classifier.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), small)
    got = {r["doc_id"]: r["score"] for r in subword_classifier.score(awkward, model).collect()}
    assert got[1] == got[2] == got[3] and len(got) == awkward.select("doc_id").distinct().count()
    texts = pa.array([t for _, t in pairs(awkward)], pa.string())
    fast = subword_classifier.scores(texts, model.per_bucket(), small)
    slow = [model.probabilities(*bag)[1] for bag in subword_classifier.bags(texts, small)]
    assert np.allclose(fast, slow, atol=1e-4)
    assert subword_classifier.score(nothing, model).count() == 0
    untrained = subword_classifier.fit(nothing, table(spark, SF, "labels"), small)
    assert set(np.round(subword_classifier.scores(texts, untrained.per_bucket(), small), 6)) == {0.5}
