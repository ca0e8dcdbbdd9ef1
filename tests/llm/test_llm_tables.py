"""Operators over whole tables: shards, packing, line runs, surrogates, near-duplicates, the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from cohortloom.llm import (bbit_minhash, components, hilbert, line_runs, mixture_packing, suffix_rules,
                            surrogates)
from cohortloom.llm.common import table
from cohortloom.llm.queries import QUERIES, vocabulary
from llm_fixtures import SF, awkward, nothing, workers_reach_the_package  # noqa: F401


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -- shards ---------------------------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (1, 3)])
def test_curve_visits_neighbours(spark, dims, bits):
    points = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(points, [f"x{i}" for i in range(dims)])
    rows = df.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(points)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, awkward, nothing, law):
    docs = table(spark, SF, "documents")
    got = hilbert.shards(docs, ["source", "lang", "n_chars"], 7, law).collect()
    text = dict(pairs(docs))
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    by = defaultdict(list)
    for r in got:
        body = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 16 and r["text_crc32"] == zlib.crc32(body)
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(7))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sizes = [sum(r["size"] for r in rs) for rs in by.values()]
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    # neighbouring shards follow the curve
    ends = sorted((k, min(r["curve"] for r in rs), max(r["curve"] for r in rs)) for k, rs in by.items())
    assert all(a[2] <= b[1] for a, b in zip(ends, ends[1:]))
    odd = hilbert.shards(awkward, ["source", "part", "n"], 3, law).collect()
    assert len(odd) == awkward.count() and (law == "bytes" or {r["shard"] for r in odd} == {0, 1, 2})
    assert hilbert.shards(nothing, ["source"], 3, law).count() == 0


def test_written_shards_prune(spark, tmp_path):
    docs = table(spark, SF, "documents")
    placed = hilbert.shards(docs, ["source", "lang"], 8)
    hilbert.write_shards(docs, placed, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(pairs(back), key=str) == sorted(pairs(docs), key=str)
    ranges = hilbert.ranges(placed, ["source", "lang"]).collect()
    hit = [sum(r["source_low"] <= s <= r["source_high"] for r in ranges) for s in ("src0", "src13", "src5")]
    assert len(ranges) == 8 and max(hit) < 8


# -- packing --------------------------------------------------------------------------

def check_packing(rows, docs, path):
    coder = Tokenizer.from_file(path)
    want = Counter()
    for d, t in docs:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, tuple(ids)] += 1
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == brute.crc(r["ids"])
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    last = max(by_seq, default=0)
    assert sorted(by_seq) == list(range(last + 1)) if rows else not by_seq
    for s, cuts in by_seq.items():
        at = 0
        for offset, length in sorted(cuts):
            assert offset == at
            at += length
        assert at == 2048 or s == last
    got = Counter()
    for d, rs in by_doc.items():
        # documents of one id are told apart by their own number of tokens and pieces
        open_ = defaultdict(list)
        for r in sorted(rs, key=lambda r: (r["doc_tokens"], r["sequence_id"], r["offset"])):
            open_[r["doc_tokens"], r["source"]].append(r)
        for (n, _), own in open_.items():
            docs_here = [[] for _ in range(sum(r["length"] for r in own) // n)]
            for r in sorted(own, key=lambda r: r["start"]):
                next(x for x in docs_here if len(x) == r["start"]).extend(r["ids"])
            for ids in docs_here:
                got[d, tuple(ids)] += 1
    assert got == want


def test_packing(spark, awkward, nothing):
    path = vocabulary("byte_bpe_50k.json")
    for docs in (awkward, table(spark, SF, "documents")):
        rows = mixture_packing.pieces(mixture_packing.pack(docs, path)).collect()
        check_packing(rows, pairs(docs), path)
    assert mixture_packing.pieces(mixture_packing.pack(nothing, path)).count() == 0
    # while all queues last, every single window holds of each source its share, give or take a turn
    total, sums = sum(r["length"] for r in rows), Counter()
    windows = defaultdict(Counter)
    for r in rows:
        sums[r["source"]] += r["length"]
        windows[r["sequence_id"]][r["source"]] += r["length"]
    assert len(sums) > 10 and len(windows) > 50
    for k in range(len(windows) - 2):
        for source, tokens in sums.items():
            share = 2048 * tokens / total
            turn = share * max(1, math.ceil(mixture_packing.LEAST / share))
            assert abs(windows[k][source] - share) <= turn + 2, (k, source)


def test_packing_to_given_shares(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "a" if i % 4 else "b" if i % 8 else None) for i in range(200)],
                                 "doc_id long, text string, source string")
    rows = mixture_packing.pieces(mixture_packing.pack(docs, vocabulary("byte_bpe_50k.json"),
                                                       shares={"a": 3, "b": 2})).collect()
    sizes = Counter(r["source"] for r in rows)
    windows = defaultdict(Counter)
    for r in rows:
        windows[r["sequence_id"]][r["source"]] += r["length"]
    # a source without a share keeps its own part: 25 of 200 documents
    for k in range(6):
        assert abs(windows[k][None] - 2048 / 8) <= 2 and abs(windows[k]["b"] - 2048 * 7 / 8 * 0.4) <= 2
    assert len(sizes) == 3 and len({r["doc_id"] for r in rows}) == 200
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    with pytest.raises(ValueError):
        mixture_packing.pack(docs, vocabulary("byte_bpe_50k.json"), shares={"a": 0})


# -- lines ----------------------------------------------------------------------------

def test_line_dedup(spark, awkward, nothing):
    for docs in (awkward, table(spark, SF, "documents")):
        got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_runs.dedup(
            docs, batches=5, fanout=2, keep=["lang"]).collect()]
        assert sorted(got, key=str) == sorted(brute.line_dedup(pairs(docs)), key=str)
    assert line_runs.dedup(nothing).count() == 0


def test_line_runs_compact(spark):
    runs = line_runs.LineRuns(spark, least=3, fanout=2)
    batches = [spark.createDataFrame([(10 * k + i, f"line {i % 3}\nown {10 * k + i}") for i in range(4)],
                                     "doc_id long, text string") for k in range(5)]
    for k, batch in enumerate(batches):
        held = line_runs.lines(batch, 3)
        assert runs.unseen(held).select("h1", "h2").distinct().count() == (7 if k == 0 else 4)
        runs.add(held)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    common = {r["n_docs"]: r["last_doc"] for r in runs.common(5).collect()}
    assert common == {10: 43, 5: 42} or sorted(common) == [5, 10]


# -- surrogates -------------------------------------------------------------------------

def test_surrogates(spark, awkward, nothing):
    got = {r["doc_id"]: r for r in surrogates.replace(awkward, "k").collect()}
    before = dict(pairs(awkward))
    for doc_id, text in before.items():
        if doc_id not in (13, 14, None):
            assert got[doc_id]["text"] == text and got[doc_id]["n_replaced"] == 0
    a, b = got[13]["text"], got[14]["text"]
    mail = re.search(r"[a-z]{3}\.[a-z]\d\d@[a-z]{4}\d\.example\.org", a)[0]
    assert "eva.b12" not in a + b and mail in b  # one address, one surrogate
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]
    digits = [int(c) for c in card if c.isdigit()][::-1]
    assert card != "4111 1111 1111 1111"
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and "555-0188" not in a
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+); Mrs\. (\w+) wrote", b)
    assert names[2] == names[5] != "Berg" and names[2] != names[4] and "10.2.3.4" not in b
    assert names[1].endswith("a") and not names[3].endswith("a")
    again = {r["doc_id"]: r["text"] for r in surrogates.replace(awkward, "k").collect()}
    other = {r["doc_id"]: r["text"] for r in surrogates.replace(awkward, "other").collect()}
    assert again[13] == a != other[13]
    assert surrogates.replace(nothing, "k").count() == 0


def test_surrogates_stay_apart(spark):
    # ten thousand line numbers of one form leave few free ones: collisions are drawn again
    rows = [(i, f"Call 212-555-{i:04d} now or Herr Иван{'а' * (i % 9)} 10.0.{i % 250}.{i // 250}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, "k").collect()}
    phones = [re.search(r"Call ([\d-]+) now", out[i])[1] for i in range(3000)]
    assert len(set(phones)) == 3000 and not set(phones) & {f"212-555-{i:04d}" for i in range(3000)}
    assert all(re.fullmatch(r"\d{3}-\d{3}-\d{4}", p) for p in phones)
    cyrillic = spark.createDataFrame([(1, "Господин Иван Петров и Госпожа Анна Петров"), (2, "Κύριος Νίκος Παππάς")],
                                     "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in surrogates.replace(cyrillic, "k").collect()}
    m = re.fullmatch(r"Господин ([А-Яа-я]+) ([А-Яа-я]+) и Госпожа ([А-Яа-я]+) ([А-Яа-я]+)", found[1])
    assert m and m[2] == m[4] != "Петров" and re.fullmatch(r"Κύριος [α-ωΑ-Ως]+ [α-ωΑ-Ως]+", found[2])


def test_crowded_and_endless_forms(spark):
    """A thousand one-letter addresses need longer surrogates; a long run of labels must not recurse."""
    users = [chr(c) for c in range(0x61, 0x2000) if chr(c).isalpha() and chr(c).islower() and len(chr(c).upper()) == 1]
    rows = [(i, f"mail {u}@x.com now") for i, u in enumerate(users[:1000])]
    rows += [(2000 + i, f"mail a@{c}.com now") for i, c in enumerate("bcdefghijklmnopqrstuvwxyz0123456789")]
    rows += [(3000 + i, f"call +12 34 {i:02d} now") for i in range(100)]
    rows += [(4000, "x@" + "a." * 500_000 + "b end"), (4001, "JOE.B@EXAMPLE.CO.UK, joe.b@example.co.uk, joe@münchen.de"),
             (4002, "IBAN DE89 3704 0044 0532 0130 00."), (4003, "DE88 3704 0044 0532 0130 00"),
             (4004, "fe80::1 at 12:30:45, 2001:0db8:85a3:0000:0000:8a2e:0370:7334")]
    out = {r["doc_id"]: r["text"] for r in surrogates.replace(
        spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    mails = [re.fullmatch(r"mail (\S+)@(\S+) now", out[i]) for i in range(1000)]
    assert len({m[1] for m in mails}) == 1000 and len({m[2] for m in mails}) == 1
    hosts = [re.fullmatch(r"mail \S+@(\S+)\.example\.org now", out[2000 + i])[1] for i in range(35)]
    assert len(set(hosts)) == 35 and len({out[3000 + i] for i in range(100)}) == 100
    assert re.fullmatch(r"[a-z]+@[a-z]+\.example\.org end", out[4000])
    a, b, c = out[4001].split(", ")
    assert a == b.upper() and b != c and "joe" not in out[4001]

    def mod97(text):
        text = re.sub("[^0-9A-Z]", "", text)
        return int("".join(str(int(x, 36)) for x in text[4:] + text[:4])) % 97
    assert mod97(out[4002][5:-1]) == 1 and out[4002] != "IBAN DE89 3704 0044 0532 0130 00."
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", out[4003]) and "3704 0044" not in out[4003]
    assert re.fullmatch(r"[0-9a-f]{4}::[0-9a-f] at 12:30:45, [0-9a-f]{4}(:[0-9a-f]{4}){7}", out[4004])


def test_surrogate_detection_is_whole(spark):
    """Against a plain reading of the planted kinds, over the whole table."""
    forms = [r"[\w.+-]+@mail\d+\.example\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<!\d)\d{16}(?!\d)",
             r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", r"(?<=token = \")[0-9a-f]{40}"]
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = {r["doc_id"]: r["text"] for r in QUERIES["op9_surrogates"](spark, "/root/testdata/sf0.01").collect()}
    held, made = defaultdict(set), defaultdict(set)
    for doc_id, text in pairs(docs):
        found = [v for f in forms for v in re.findall(f, text)]
        assert not [v for v in found if v in out[doc_id]]
        assert (out[doc_id] != text) == bool(found)
        for value in found:
            held[value].add(doc_id)
    assert len(held) > 50


def test_surrogates_of_long_values(spark):
    """Values longer than any fixed length are replaced to their last character."""
    rng = random.Random(4)

    def word(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    values = [word(alnum, 200), word("0123456789abcdef", 700), word(alnum, 5000),
              f"eyJ{word(alnum, 30)}.eyJ{word(alnum, 90)}.{word(alnum, 43)}", f"{word(alnum, 12)}/{word(alnum, 40)}+aZ9==",
              f"ab1/{word(alnum, 20)}~x", "12345678901234567"]
    rows = [(i, f'token = "{v}" end') for i, v in enumerate(values)] + [
        (20, "Mr Juan Carlos Garcia Lopez left"), (21, "Mr " + " ".join(f"Na{c}" for c in "abcdefgh" * 600) + " left"),
        (22, "Mr McDonald met Mrs O'Brien."), (23, f"key={word(alnum, 20)}. Next"),
        (30, "pay 378282246310005 now"), (31, "pay 3782 822463 10005 now"), (32, "pay 4222222222222 now"),
        (33, "pay 6304000000000000000 now"), (34, "pay 6304-0000-0000-0000-000 now"), (35, "pay 30569309025904 now"),
        (40, "at 1700000000000 ms"), (41, "key: " + "-" * 30), (42, "2024 212555 0188"), (43, "4111 1111 1111 1111 124")]
    out = {r["doc_id"]: r for r in surrogates.replace(
        spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, v in enumerate(values):
        made = re.fullmatch(r'token = "(\S+)" end', out[i]["text"])[1]
        assert len(made) == len(v) and out[i]["n_replaced"] == 1
        assert re.sub(r"[A-Za-z0-9]", "", made) == re.sub(r"[A-Za-z0-9]", "", v)
        assert not any(v[k:k + 8] in made for k in range(len(v) - 7))
    assert re.fullmatch(r"Mr [a-zA-Z]+ [a-zA-Z]+ [a-zA-Z]+ [a-zA-Z]+ left", out[20]["text"])
    assert not re.search("Juan|Carlos|Garcia|Lopez", out[20]["text"])
    assert not re.search(r"Na[a-h]\b", out[21]["text"]) and len(out[21]["text"].split()) == 4802
    assert not re.search("Mc|Donald|Brien", out[22]["text"]) and out[22]["n_replaced"] == 2
    assert out[23]["text"].endswith(". Next") and out[23]["text"] != dict(rows)[23]
    for i in range(30, 36):
        digits, was = (re.sub(r"[^0-9]", "", t) for t in (out[i]["text"], dict(rows)[i]))
        assert digits != was and re.sub("[0-9]", "0", out[i]["text"]) == re.sub("[0-9]", "0", dict(rows)[i])
        assert sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    for i in (40, 41):
        assert (out[i]["text"], out[i]["n_replaced"]) == (dict(rows)[i], 0)
    assert out[42]["text"].startswith("2024 ") and "212555 0188" not in out[42]["text"]
    assert out[43]["text"].endswith(" 124") and "4111 1111" not in out[43]["text"]


# -- near-duplicates ----------------------------------------------------------------------

def family(n, words, seed, edits=1):
    """Texts that drift from one another by a few words at each step."""
    rng = random.Random(seed)
    body = [f"v{seed}w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        for _ in range(edits):
            body[rng.randrange(words)] = f"e{rng.randrange(1 << 30)}"
        out.append(" ".join(body))
    return out


def check_near(spark, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                 for r in bbit_minhash.near_duplicates(docs).collect())
    assert got == brute.components(pairs(docs))
    return got


def test_near_duplicates(spark, awkward, nothing):
    got = {r["doc_id"]: r for r in bbit_minhash.near_duplicates(awkward).collect() if r["doc_id"] is not None}
    want = {d: (n, c, k) for d, n, c, k in brute.components([p for p in pairs(awkward) if p[0] is not None])}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == want
    missing = [r for r in bbit_minhash.near_duplicates(awkward).collect() if r["doc_id"] is None]
    # a row without an id gives way to its near-duplicate with one; alone it stays
    assert sorted((r["kept"], r["component_id"]) for r in missing) == [(False, 6), (True, None)]
    assert bbit_minhash.near_duplicates(nothing).count() == 0
    kept = bbit_minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted(d for d, (_, _, k) in want.items() if k)
    check_near(spark, table(spark, SF, "documents"))


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Drifting families, copies and blocks far below their production size."""
    texts = [t for s in range(4) for t in family(60, 80, s, 1 + s % 2)] + family(1, 80, 9) * 50 + family(40, 9, 7)
    random.Random(3).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = check_near(spark, docs)
    monkeypatch.setattr(bbit_minhash, "BUCKET_ROWS", 10)
    monkeypatch.setattr(bbit_minhash, "GROUP_ELEMENTS", 900)
    monkeypatch.setattr(bbit_minhash, "ANCHORS", 2)
    assert check_near(spark, docs) == whole


def test_estimate_follows_the_similarity():
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.75, 0.95):
        n = int(round(2 * share * 1000 / (1 + share)))
        a, b = base[:1000], np.concatenate([base[:n], base[1000:2000 - n]])
        mins = bbit_minhash.minima(np.concatenate([a, b]), np.array([0, 1000, 2000]), 512)
        sig = bbit_minhash.packed(mins)
        equal = bbit_minhash.equal_slots(sig[:1], sig[1:])
        assert abs(bbit_minhash.estimate(equal, 512)[0] - share) < 0.1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + rng.randrange(1, 40)) for _ in range(60)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in got if i >= 100} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- pipeline -----------------------------------------------------------------------------

def test_pipeline(spark, awkward):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    limits = suffix_rules.Limits()
    left = []
    for d, t in pairs(docs):
        n, _, _, _, repeat = brute.base_counts(t)
        best = suffix_rules.measure([(t or "").encode()], limits)
        if n >= 50 and 100 * repeat <= 50 * n and best["kept"][0]:
            left.append((d, t))
    left = [(d, t) for d, t, _, _ in brute.line_dedup(left)]
    one = {d for d, _, _, kept in brute.components(left) if kept}
    left = [(d, t) for d, t in left if d in one]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {x[0] for x in brute.contamination(left, items) if x[-1]}
    check_packing(rows, [(d, t) for d, t in left if d not in bad], vocabulary("byte_bpe_50k.json"))
    assert bad and len(one) < len(left) + len(bad) + 200


def test_stages_take_any_rows(spark, awkward, nothing):
    import corpus_pipeline
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "pack":
                assert out.columns[:5] == corpus_pipeline.COLUMNS
            assert out.count() >= 0
