"""License notices, filter interactions and the Merkle manifest against plain versions."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from cohortloom.llm import filter_diagrams, license_join, merkle_witness
from cohortloom.llm.common import table
from cohortloom.llm.oracle import ORACLE
from cohortloom.llm.queries import QUERIES
from llm_fixtures import SF, awkward, nothing, workers_reach_the_package  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = sorted(found.columns)
    assert sorted(d[0] for d in want.description) == names
    place = {d[0]: i for i, d in enumerate(want.description)}
    rows = sorted(map(str, (tuple(r[place[c]] for c in names) for r in want.fetchall())))
    assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == rows


# -- license notices --------------------------------------------------------------------

MIT = next(t for label, t in license_join.TEMPLATES if label == "mit" and len(t) > 100)


def plain_scan(texts, templates, threshold):
    known = license_join.Templates(templates, threshold).sets
    out = []
    for text in texts:
        held = brute.FOLDED.findall((text or "").translate(brute.UP))
        at, base, labels, part = [], set(), set(), 0.0
        for phrase, label in license_join.PHRASES.items():
            p = phrase.split()
            mine = [i for i in range(len(held)) if held[i:i + len(p)] == p]
            at += mine
            base |= {label} if mine else set()
        for label, size, wanted, required in known:
            for b in range(0, len(held), size):
                shared = len(set(held[b:b + 2 * size]) & set(wanted))
                if shared >= required:
                    labels.add(label)
                    part = max(part, shared / len(wanted))
        out.append((len(held), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | labels)), 1.0 if base else part))
    return out


def scanned(df, **options):
    rows = license_join.scan(df, **options).orderBy("doc_id").collect()
    return [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"],
             pytest.approx(r["score"])) for r in rows]


def test_notices(spark):
    wrapped = MIT.replace(", ", ",\n# ").upper()
    shorter = MIT.replace("sublicense, ", "").replace("furnished", "given").replace("merge", "join")
    lost = " ".join(MIT.split()[:30])
    texts = ["mit license", "MIT\nLicense, Apache-license; GENERAL public  license mit license", None, "", "...",
             "license", "mit licenses", wrapped, "x " * 77 + MIT + " y" * 50, shorter, lost,
             "Licensed under CC BY-NC 4.0.", "licensed CC-BY under 4.0", "under the terms of the lesser general",
             "Das KKelvin été İ mit license", " ".join(t for _, t in license_join.TEMPLATES),
             ("the mit of license general public under 4 0 " * 500) + "public license apache license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert scanned(df) == plain_scan(texts, license_join.TEMPLATES, license_join.THRESHOLD)
    rows = scanned(df)
    assert [r[5] for r in rows[:2]] == ["mit", "apache,gpl,mit"] and rows[2][:6] == (0, 0, None, None, "", "")
    assert rows[7][5] == rows[8][5] == rows[9][5] == "mit" and rows[10][5] == "" and rows[11][5] == "cc-by-nc"


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_join_is_exact(spark, threshold):
    rng = random.Random(threshold)
    pool = [f"w{i}" for i in range(12)]
    templates = [(f"t{k}", " ".join(rng.choices(pool, k=rng.randint(1, 20)))) for k in range(8)] + [("none", "..")]
    texts = [" ".join(rng.choices(pool + ["z"] * rng.randint(0, 40), k=rng.randint(0, 90))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert scanned(df, templates=templates, threshold=threshold) == plain_scan(texts, templates, threshold)


def test_notices_of_awkward_rows(spark, awkward, nothing):
    rows = license_join.scan(awkward).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=str)
    want = plain_scan([t for _, t in texts], license_join.TEMPLATES, license_join.THRESHOLD)
    assert sorted((str(r["doc_id"]), r["n_words"], r["labels"], r["score"]) for r in rows) == \
        sorted((str(d), w[0], w[5], w[6]) for (d, _), w in zip(texts, want))
    assert license_join.scan(nothing).count() == 0
    assert {r["labels"] for r in license_join.scan(awkward, templates=[]).collect()} == {""}
    with pytest.raises(ValueError):
        license_join.scan(awkward, templates=[("x", " ".join(f"w{i}" for i in range(20_001)))])


# -- filter interactions ----------------------------------------------------------------

def test_swaps_visit_every_order():
    for n in range(1, 6):
        order = list(range(n))
        seen = {tuple(order)}
        for k in filter_diagrams.level_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n)))) == 1 + sum(1 for _ in filter_diagrams.level_swaps(n))


def test_diagram_shares_nodes():
    diagram = filter_diagrams.Diagram("ABCDE", {m: (1,) for m in range(32)})
    assert len(diagram.below) == 6 and diagram.weight[diagram.root] == (32,)


def plain_audit(rows, labels):
    """rows: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    found = defaultdict(list)
    for d, text, part in rows:
        body = text or ""
        w = brute.words(body)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in body) > 3 * len(body),
                 "D": any(c in "#$%&*|" for c in body),
                 "E": d is not None and least[body] < d}
        found[part or ""].append((fails, d in good, d in toxic))
    out = []
    for part, docs in found.items():
        mine, shares = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                shares[f] += len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone),
                             sum(x[0][f] for x in docs) - len(gone),
                             sum(x[0][f] and sum(x[0].values()) == 1 for x in docs),
                             sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*r, shares[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def test_audit(spark, awkward, nothing):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, filter_diagrams.audit(docs, labels).collect())) == plain_audit(rows, marks)
    # repeated rows and ids, one id with two texts, several labels of an id
    twice = awkward.unionByName(awkward.filter("doc_id in (4, 8)"))
    odd = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (10, None, 1), (99, 1, 1)],
                                "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in twice.collect()]
    assert sorted(map(tuple, filter_diagrams.audit(twice, odd).collect())) == \
        plain_audit(rows, [tuple(r) for r in odd.collect()])
    assert filter_diagrams.audit(nothing, labels).count() == 0
    assert filter_diagrams.audit(awkward, nothing.selectExpr("doc_id", "0 quality", "0 toxic")).count() == 3 * 600 + 600


# -- manifest ---------------------------------------------------------------------------

def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); the sorted output of the operator."""
    def h(text):
        return sha256(text.encode()).hexdigest()

    def leaf(cells):
        return h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))

    def build(digests):
        """root and, per leaf, [(sibling or None, whether it stands left)]"""
        paths, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
        while len(level) > 1:
            up, up_owners = [], []
            for i in range(0, len(level), 2):
                pair = level[i:i + 2]
                for k, owner in enumerate(owners[i:i + 2]):
                    for o in owner:
                        paths[o].append((pair[1 - k] if len(pair) == 2 else None, k == 1))
                up.append(h("".join(pair)))
                up_owners.append(sum(owners[i:i + 2], []))
            level, owners = up, up_owners
        return level[0], paths

    def fold(digest, path):
        for sibling, left in path:
            digest = h(digest if sibling is None else sibling + digest if left else digest + sibling)
        return digest

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(build([d for _, d in groups[g]]))
    if not names:
        return []
    root, crown = build([t[0] for t in trees])
    out = []
    for g, (subroot, paths), upper in zip(names, trees, crown):
        for (r, digest), path in zip(groups[g], paths):
            read = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                read = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            folded = fold(read, path + upper)
            proof = h("".join(s for s, _ in path + upper if s))
            out.append((r[0], digest, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def sevenths(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest(spark, awkward, nothing, levels):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tables = [awkward.unionByName(awkward.filter("doc_id in (4, 8) or doc_id is null"))]
    if levels in (3, 12):
        tables.append(table(spark, SF, "documents"))
    for docs in tables:
        found = merkle_witness.manifest(docs, sevenths, levels=levels).select(*names).collect()
        want = plain_manifest([tuple(r) for r in docs.select(*fields).collect()])
        assert sorted(map(tuple, found), key=str) == want
        assert 0 < sum(r["verified"] for r in found)
    assert merkle_witness.manifest(nothing, sevenths, levels=levels).count() == 0


def test_manifest_of_many_groups_and_one(spark):
    docs = spark.range(70).selectExpr("id doc_id", "cast(id as string) lang", "'s' source", "id n_chars", "'t' text")
    for df in (docs, docs.withColumn("lang", F.lit("x")), docs.filter("doc_id = 3"), docs.filter("doc_id < 65")):
        found = merkle_witness.manifest(df, sevenths, levels=2)
        rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        assert sorted(map(tuple, found.drop("lang", "proof").collect()), key=str) == plain_manifest(rows)


def test_witnesses_grow_by_appends():
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [sha256(str(i).encode()).digest() for i in range(n)]
        block = merkle_witness.Witnesses()
        for d in leaves:
            block.append(d)
            sizes = [1 << s.level for s in block.open]
            assert sizes == sorted(set(sizes), reverse=True)
        root, witnesses = block.close(merkle_witness.height_of(n))
        for i, w in enumerate(witnesses):
            body = b"".join(w)
            assert merkle_witness.fold(leaves[i], i, n, body) == (root, len(body))
