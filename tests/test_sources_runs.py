"""Files in, results out: snapshots, registers, runs, retrieval and trace."""

import json

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import ablation, retrieval, runs, trace
from cohortloom.plans.trial import Trial
from cohortloom.sources import registry, scratch, snapshot
from cohortloom.sources.snapshot import (IngestError, Snapshot, duplicate_documents, fingerprint,
                                         with_numbers)

V2 = "cutaneous_mucosal.v2"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("snapshot")
    (root / "dm.csv").write_text("STUDYID,USUBJID,AGE\nSTUDY-A,S1,44\nSTUDY-G,S2,about 50\n")
    (root / "ae.csv").write_text(
        "STUDYID,USUBJID,AESPID,AETERM,AEDECOD,AEDICTVER,AEMUCOS,AEGRADE,AESTDTC,EXTRA\n"
        'STUDY-A,S1,R1,"rash, ""red""",Rash,D-21.0,Y,2,2022-01-06,x\n'
        "STUDY-G,S2,R2,rash,Rash,D-21.0,,2.5,2022-01-07,\n")
    (root / "ex.csv").write_text("STUDYID,USUBJID,EXSEQ,EXDOSE,EXSTDTC\nSTUDY-A,S1,1,10,2022-01-01\n"
                                 "STUDY-G,S2,1,10,01/Jan/2022\n")
    (root / "documents.jsonl").write_text("\n".join(json.dumps(d) for d in (
        {"doc_id": "D1", "study_id": "STUDY-G", "subject_id": "S2", "source_record_id": "R2",
         "header": "HEADER", "text": "no oral ulceration was seen"},
        {"doc_id": "D2", "study_id": "STUDY-G", "subject_id": "S2", "text": "unlinked"})))
    (root / "manifest.json").write_text(json.dumps(
        {"profiles": {"P_structured": {"study_id": "STUDY-A"}}}))
    return root


@pytest.fixture(scope="module")
def loaded(spark, files):
    return Snapshot.load(spark, str(files))


def test_load(loaded):
    ae = {r["AESPID"]: r for r in with_numbers(loaded.ae).collect()}
    assert ae["R1"]["AETERM"] == 'rash, "red"' and ae["R2"]["AEMUCOS"] is None
    assert ae["R1"]["EXTRA"] == "x" and ae["R1"]["AEREL"] is None
    assert (ae["R2"]["AEGRADE"], ae["R2"]["AEGRADE_N"], ae["R2"]["AEGRADE_IS_WHOLE"]) == (
        "2.5", 2.5, False)
    age = {r["USUBJID"]: (r["AGE"], r["AGE_N"]) for r in with_numbers(loaded.dm).collect()}
    assert age["S2"] == ("about 50", None)
    docs = {r["doc_id"]: r for r in loaded.documents.collect()}
    assert docs["D1"]["full_text"] == "HEADER\nno oral ulceration was seen"
    assert (docs["D2"]["full_text"], docs["D2"]["kind"], docs["D2"]["source_record_id"]) == (
        "unlinked", "comment", "")
    assert loaded.sc.count() == 0 and loaded.profile_of("STUDY-A") == "P_structured"
    with pytest.raises(IngestError):
        loaded.gold()


def test_missing_required_table(spark, tmp_path):
    with pytest.raises(IngestError):
        Snapshot.load(spark, str(tmp_path))


def test_access_paths(loaded):
    assert {tuple(r) for r in loaded.cohort().collect()} == {("S1", "STUDY-A"), ("S2", "STUDY-G")}
    assert loaded.cohort(["STUDY-A"]).count() == 1
    assert [r["AESPID"] for r in loaded.ae_ordered().collect()] == ["R1", "R2"]
    assert [r["doc_id"] for r in loaded.documents_for("S2").collect()] == ["D1", "D2"]
    assert [r["doc_id"] for r in loaded.documents_of("R2").collect()] == ["D1"]
    assert loaded.subject_rows("S1", "ex").count() == loaded.study_rows("STUDY-A", "ae").count() == 1
    assert loaded.summary().first()["documents"] == 2
    assert duplicate_documents(loaded.documents.union(loaded.documents)).count() == 2


def test_fingerprint_ignores_order_only(spark, loaded):
    df = loaded.ae
    same = fingerprint(df.orderBy(F.desc("AESPID")).repartition(5), "ae").collect()
    assert same == fingerprint(df, "ae").collect()
    blank = df.withColumn("AEMUCOS", F.coalesce("AEMUCOS", F.lit("")))
    assert fingerprint(blank, "ae").collect() != same
    assert loaded.snapshot_id() == loaded.snapshot_id()


def test_loaded_trial_end_to_end(loaded):
    got = {r["source_record_id"]: (r["verdict"], r["attribute_sources"]["mucosal_involvement"])
           for r in Trial(loaded).assignments(V2).collect()}
    assert got == {"R1": ("case", "AEMUCOS"), "R2": ("non_case", "CO.COVAL")}


def test_run_register_and_replay(spark, loaded, tmp_path):
    results, register = str(tmp_path / "results"), str(tmp_path / "runs")
    assert registry.status(registry.manifests(spark, register)).first()["manifests"] == 0
    t = Trial(loaded)
    d = t.definition(V2)
    manifest, assignments = runs.execute(t, d, results, register, question="how many?")
    assert manifest["counts_by_verdict"] == {"case": 1, "non_case": 1}
    assert manifest["attribute_methods"] == {"derived": 1, "direct": 2}
    assert registry.read_results(spark, results, manifest["manifest_id"]).count() == 2
    again, _ = runs.execute(t, d, results, register, save=False)
    assert again["manifest_id"] == manifest["manifest_id"]
    assert again["results_hash"] == manifest["results_hash"]
    other, _ = runs.execute(t, d, results, register, studies=["STUDY-A"], actor="someone")
    assert other["manifest_id"] != manifest["manifest_id"]

    assert runs.replay(t, manifest["manifest_id"], d, results, register)["reproduced"]
    t2 = Trial(loaded, t.config.reading(("reported_term",)))
    moved = runs.replay(t2, manifest["manifest_id"], d, results, register)
    assert {m["part"] for m in moved["differences"]} == {
        "extractor version", "results hash", "manifest id"}

    (tmp_path / "runs" / "foreign.json").write_text("not a manifest\n")
    listed = registry.manifests(spark, register)
    assert listed.count() == 2
    assert registry.find(listed, actor="someone").count() == 1
    assert registry.find(listed, definition_id="other").count() == 0
    assert registry.last_runs(listed, 1).count() == 1
    assert registry.status(listed).first()["definitions_used"] == [V2]
    for missing in (lambda: registry.load_manifest(spark, register, "nope"),
                    lambda: registry.read_results(spark, results, "nope")):
        with pytest.raises(registry.RunNotFound):
            missing()


def test_trace(loaded):
    t = Trial(loaded)
    d = t.definition(V2)
    manifest = {"manifest_id": "m", "actor": "a", "normalizer_version": "n",
                "extractor_version": "x", "data_snapshot_id": "s", "definition_id": d.id,
                "definition_version": d.version, "definition_status": d.status,
                "definition_hash": d.content_hash}
    args = (t.assignments(V2), t.attributes, t.records, manifest, "case count", 1)
    chain = trace.trace_number(*args)
    levels = [r["level"] for r in chain.collect()]
    assert levels[:4] == ["result", "analysis", "cohort", "definition"]
    assert levels.count("attribute") == 3 and levels.count("record") == 1
    assert levels.count("span") == 5 and trace.broken_at(chain) is None
    assert trace.broken_at(trace.trace_number(*args, verdict="review")) == "record"
    lost = trace.trace_number(args[0], t.attributes, t.records.filter("false"), *args[3:])
    assert trace.broken_at(lost) == "record"
    bare = t.attributes.withColumn("evidence", F.slice("evidence", 1, 0))
    assert trace.broken_at(trace.trace_number(args[0], bare, *args[2:])) == "span"


def test_evidence_package(loaded, tmp_path):
    body = Trial(loaded).evidence_package(V2, str(tmp_path / "res"), str(tmp_path / "runs"))
    assert body["supportability"]["mucosal_involvement"].count() == 7
    assert body["manifest"]["n_records"] == 2
    assert body["covariates"].filter("covariate = 'sex'").first()["value"] == "unknown"


def test_retrieval_tables(spark, loaded, tmp_path):
    t = Trial(loaded)
    path = str(tmp_path / "index")
    meta = {"extractor_version": t.config.extractor_version,
            "normalizer_version": t.config.normalizer_version, "modifier": "mucosal_involvement"}
    retrieval.build_index(path, t.flat(), t.mentions(), loaded.documents, meta)
    built = spark.read.json(f"{path}/meta")
    assert retrieval.stale(built, meta["extractor_version"], meta["normalizer_version"]).count() == 0
    assert [r["part"] for r in retrieval.stale(built, "newer", meta["normalizer_version"])
            .collect()] == ["extractor_version"]
    flat = spark.read.parquet(retrieval.update_verdicts(path, t.assignments(V2)))
    got = retrieval.retrieve(flat, t.config, concept="RASH", verdict=["case"]).collect()
    assert [(r["record_id"], r["definition"]) for r in got] == [("STUDY-A:R1", V2)]
    assert retrieval.retrieve(flat, t.config, group="CUTANEOUS", window=(0, 5)).count() == 1
    assert {r[0] for r in retrieval.stored_studies(flat).collect()} == {"STUDY-A", "STUDY-G"}
    with pytest.raises(Exception, match="unknown concept"):
        retrieval.retrieve(flat, t.config, concept="NOBODY")
    # a second definition is written over the first one's table: verdicts it does not give stay
    again = spark.read.parquet(retrieval.update_verdicts(path, t.assignments("graded_toxicity.v1")))
    kept = {r["record_id"]: r["definition_id"] for r in again.filter("verdict is not null").collect()}
    assert kept["STUDY-A:R1"] == "cutaneous_mucosal"
    assert retrieval.current_records(spark, path)[0] == 2


def test_search_results_are_no_cohort(loaded):
    t = Trial(loaded)
    found = t.discover("ulceration SEEN")
    row = found.first()
    assert row["doc_id"] == "D1" and row["candidate"] and row["score"] < 0
    assert t.discover("ulceration nowhere").count() == 0
    with pytest.raises(retrieval.CandidateInCohort):
        retrieval.as_cohort(found)
    assert retrieval.as_cohort(t.retrieve()).count() == 2


def test_rerank(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "mention_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 0.0])],
                                    "mention_id string, embedding array<float>")
    assert [r["mention_id"] for r in retrieval.rerank(rows, vectors, [1.0, 0.1]).collect()] == [
        "a", "c", "b"]
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query array<float>")
    both = retrieval.rerank(rows, vectors, queries, top_k=1).collect()
    assert [(r["query_id"], r["mention_id"]) for r in both] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="query_id"):
        retrieval.rerank(rows, vectors, queries.drop("query_id")).collect()


def test_edited_definition_is_judged_anew(loaded, tmp_path):
    from dataclasses import replace
    t = Trial(loaded)
    d = t.definition(V2)
    before = {r["record_id"]: r["verdict"] for r in t.assignments(d).collect()}
    closed = replace(d, temporal=replace(d.temporal, minimum=-2, maximum=-1))
    after = {r["record_id"]: r["verdict"] for r in t.assignments(closed).collect()}
    assert closed.key == d.key and closed.content_hash != d.content_hash
    assert "case" in before.values() and "case" not in after.values()
    first, _ = runs.execute(t, d, str(tmp_path / "res"), str(tmp_path / "runs"))
    moved = {x["part"] for x in runs.replay(t, first["manifest_id"], closed, str(tmp_path / "res"),
                                            str(tmp_path / "runs"))["differences"]}
    assert {"definition", "results hash", "manifest id"} <= moved


def test_last_duplicate_document_wins(spark, tmp_path):
    (tmp_path / "documents.jsonl").write_text("\n".join(
        '{"doc_id": "D1", "text": "%s"}' % t for t in ("first", "second", "last")) + '\n{"doc_id": "D2", "text": "own"}')
    got = {r["doc_id"]: r["text"] for r in snapshot.read_documents(spark, str(tmp_path / "documents.jsonl")).collect()}
    assert got == {"D1": "last", "D2": "own"}


def test_written_tables_survive_reuse(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda session: str(tmp_path))
    table = scratch.written(spark.range(5), "five")
    assert table.count() == table.count() == 5
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["five"]


def test_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf, sparkContext = {}, Context()
    with pytest.raises(scratch.NoSharedFolder):
        scratch.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/tmp/"}
    assert scratch.shared_folder(Session()) == "hdfs://shared/tmp"


def test_query_syntax(spark):
    docs = spark.createDataFrame([(1, "Déjà vu, deja-vu again"), (2, "deja and later vu"), (3, "dejaX vu only")],
                                 "doc_id int, full_text string").withColumn("kind", F.lit("d"))
    index = retrieval.text_index(docs)
    for query, want in (("déjà", {1, 2}), ("DEJA vu", {1, 2}), ('"deja vu"', {1}), ("dej* vu", {1, 2, 3}),
                        ("vu -again", {2, 3}), ('vu -"deja vu"', {2, 3})):
        assert {r["doc_id"] for r in retrieval.bm25(index, query).collect()} == want, query
    with pytest.raises(ValueError):
        retrieval.bm25(index, "-vu")


def test_search_folds_both_sides_alike(spark):
    """Other scripts keep their marks; Latin letters lose theirs, precomposed or not."""
    import unicodedata
    terms = ["район", "Άνθρωπος", "データ", "한국어", "exanthème", "Ångström", "tiếng"]
    docs = [(f"D{i}", "comment", f"before {form} after") for i, t in enumerate(terms)
            for form in [t]] + [(f"N{i}", "comment", f"before {unicodedata.normalize('NFD', t)} after")
                                for i, t in enumerate(terms) if i > 3]
    index = retrieval.text_index(spark.createDataFrame(docs, "doc_id string, kind string, full_text string"))
    for i, t in enumerate(terms):
        want = {f"D{i}", f"N{i}"} if i > 3 else {f"D{i}"}
        for asked in {t, t.upper(), unicodedata.normalize("NFD", t) if i > 3 else t}:
            got = retrieval.bm25(index, asked).collect()
            assert {r["doc_id"] for r in got} == want and len({r["score"] for r in got}) == 1, asked


def test_trace_builds_only_what_it_shows(spark, tmp_path):
    """Findings, records and attributes are built for the examples alone."""
    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        built.add(1)
        return x
    rows = spark.range(200).select(
        F.format_string("S:%03d", "id").alias("record_id"), F.format_string("%03d", "id").alias("source_record_id"),
        F.lit("S").alias("study_id"), F.lit("p").alias("subject_id"), F.lit("case").alias("verdict"))
    reason = seen("record_id").alias("reason")
    judged = rows.withColumn("findings", F.array(F.struct(
        F.lit("concept").alias("name"), F.lit(True).alias("satisfied"), reason)))
    recs = rows.select("record_id", "source_record_id", "study_id", F.lit("AE").alias("source_form_id"),
                       F.lit("P").alias("profile"), seen("record_id").alias("normalizer_version"))
    spans = rows.select("record_id", "source_record_id", F.array(F.struct(
        F.lit("f").alias("field"), F.lit(0).alias("start"), F.lit(1).alias("end"), seen("record_id").alias("doc_id"),
        F.lit("v").alias("extracted_value"))).alias("evidence"))
    manifest = {k: "x" for k in ("manifest_id", "actor", "normalizer_version", "extractor_version", "data_snapshot_id",
                                 "definition_id", "definition_version", "definition_status", "definition_hash")}
    chain = trace.trace_number(judged, spans, recs, manifest, "cases").collect()
    assert [r["identifier"] for r in chain if r["level"] == "record"] == ["S:000", "S:001", "S:002"]
    assert [r["detail"] for r in chain if r["level"] == "attribute"] == ["S:000", "S:001", "S:002"]
    assert "200 record(s)" in next(r["detail"] for r in chain if r["level"] == "cohort")
    assert built.value <= 60


def test_evaluation_writes_no_findings(spark, loaded, monkeypatch):
    from dataclasses import replace
    from cohortloom.plans import trial as plans
    gold = spark.createDataFrame([], ", ".join(f"{c} string" for c in (
        "source_record_id", "truth_id", "cohort", "true_verdict", "verdict_if_readable", "structured_assertion",
        "text_assertion", "true_availability", *(f"verdict_stage_{s}" for s in ablation.STAGES))) + ", readable boolean")
    made = {}

    def kept(df, name, **options):
        made[name] = df.columns
        return scratch.written(df.limit(0), name, **options)
    monkeypatch.setattr(plans, "written", kept)
    Trial(replace(loaded, gold_rows=gold)).evaluation(V2)
    assert not {"reason", "findings", "evidence_spans"} & set(made["evaluation-judged"])
    assert "structured_assertion" in made["evaluation-gold"] and "verdict_stage_comments" not in made["evaluation-gold"]


def test_evaluation_reads_records_once(spark, loaded, monkeypatch):
    from dataclasses import replace
    from cohortloom.operators import evaluate, normalize
    from cohortloom.plans import trial as plans
    gold = spark.createDataFrame([], ", ".join(f"{c} string" for c in (
        "source_record_id", "truth_id", "cohort", "true_verdict", "verdict_if_readable", "structured_assertion",
        "text_assertion", "true_availability", *(f"verdict_stage_{s}" for s in ablation.STAGES))) + ", readable boolean")
    links, made, link = [], {}, normalize.link

    def linked(snap, config, text=normalize.NO_TEXT, anchor=None):
        links.append(text)
        return link(snap, config, text, anchor)

    def kept(df, name, **options):
        made[name] = scratch.written(df if name == "evaluation-judged" else df.limit(0), name, **options)
        return made[name]
    monkeypatch.setattr(normalize, "link", linked)
    monkeypatch.setattr(plans, "written", kept)
    t = Trial(replace(loaded, gold_rows=gold))
    t.evaluation(V2)
    # one reading of texts serves verdicts, assertions and all stages
    assert links.count(normalize.ANSWERS) == 1
    judged = evaluate.in_concept_set(made["evaluation-judged"], t.definition(V2), t.config).select(
        "record_id", "verdict", "reported_term", "comments")
    whole = t.assignments(V2).select("record_id", "verdict").join(
        ablation.judge(ablation.staged_records(t.snapshot, t.config, t.definition(V2)), t.definition(V2),
                       ablation.stage_maps(), "record_id").select("record_id", "reported_term", "comments"), "record_id")
    assert sorted(map(tuple, judged.collect())) == sorted(map(tuple, whole.collect())) != []
