"""One trial: a snapshot read through a configuration, with its jobs as lazy DataFrames."""

from __future__ import annotations

from functools import cached_property
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TrialConfig
from ..definitions import Definition, shipped_definitions
from ..functions import attrs
from ..operators import (ablation, aggregates, compare, episodes, evaluate, extract, normalize,
                         retrieval, runs, scoring, silver, text_search, trace)
from ..sources.scratch import written
from ..sources.snapshot import Snapshot

#: The modifier that views take where none is named.
MODIFIER = "mucosal_involvement"


class Trial:
    """Plans are built once and reused; nothing runs until a result is asked for."""

    def __init__(self, snapshot: Snapshot, config: TrialConfig | None = None,
                 definitions: dict[str, Definition] | None = None,
                 reader: extract.Reader | None = None):
        self.snapshot = snapshot
        self.config = config or TrialConfig.default()
        self.definitions = definitions or shipped_definitions()
        self.reader = reader
        self.backend = "rules" if reader is None else "model"
        self._evaluated: dict[str, DataFrame] = {}
        self._mentions: dict[str, DataFrame] = {}

    @property
    def spark(self) -> SparkSession:
        return self.snapshot.spark

    @cached_property
    def snapshot_id(self) -> str:
        return self.snapshot.snapshot_id()

    # -- records ----------------------------------------------------------------
    @cached_property
    def structured(self) -> DataFrame:
        """Records from structured reading alone."""
        return normalize.records(self.linked, self.config)

    @cached_property
    def linked(self) -> DataFrame:
        return normalize.link(self.snapshot, self.config)

    @cached_property
    def records(self) -> DataFrame:
        """Records with open modifiers filled from prose."""
        return self._read()

    def _read(self) -> DataFrame:
        linked = normalize.link(self.snapshot, self.config, normalize.ANSWERS) \
            if self.reader is None else normalize.link(self.snapshot, self.config)
        return extract.enrich(normalize.records(linked, self.config), self.config,
                              self.snapshot.documents, self.reader)

    @cached_property
    def attributes(self) -> DataFrame:
        return normalize.attribute_table(self.records, self.config)

    def records_carrying(self, fields: Sequence[str], spans: Sequence[str] = ()) -> DataFrame:
        """Records whose attributes and spans carry these fields only; the others are null."""
        with attrs.carrying(fields, spans):
            return self._read()

    def attribute_fields(self, *fields: str) -> DataFrame:
        """The attribute table with some fields of each attribute only; of spans there is only their number."""
        return normalize.attribute_table(self.records_carrying(fields), self.config, fields)

    def spans(self) -> DataFrame:
        """Distinct evidence spans per record."""
        lists = normalize.attribute_lists(self.records_carrying(("evidence",), attrs.SPAN_KEYS), self.config,
                                          ("evidence",))
        return normalize.spans(lists, normalize.repeated(self.structured))

    # -- evaluation ---------------------------------------------------------------
    def structured_assignments(self, definition: str) -> DataFrame:
        """The definition over structured reading alone."""
        return evaluate.evaluate(self.structured, self.definitions[definition], self.config,
                                 self.snapshot.ex)

    def definition(self, key: str) -> Definition:
        return self.definitions[key]

    def assignments(self, definition: Definition | str, studies: Sequence[str] | None = None
                    ) -> DataFrame:
        d = self.definitions[definition] if isinstance(definition, str) else definition
        kept = d.content_hash
        if kept not in self._evaluated:
            # without a modifier criterion no prose can matter, so none is read
            recs = self.records if d.modifiers else self.structured
            self._evaluated[kept] = evaluate.evaluate(recs, d, self.config, self.snapshot.ex)
        return aggregates.study_filter(self._evaluated[kept], studies)

    def supportability(self, modifier: str) -> DataFrame:
        """Which studies can answer at all, from declared metadata; no patient row is read."""
        return self.spark.createDataFrame(
            self.config.support(modifier), "study_id string, profile string, status string, reason string, "
                  "homes array<string>")

    def supportable(self, df: DataFrame, modifier: str) -> DataFrame:
        """Rows of studies that can answer; the short list prunes partitions."""
        able = [study for study, _, status, _, _ in self.config.support(modifier)
                if status != "cannot_ascertain"]
        return df.filter(F.col("study_id").isin(*sorted(able)))

    # -- prose ----------------------------------------------------------------------
    def mentions(self, modifier: str = MODIFIER) -> DataFrame:
        if modifier not in self._mentions:
            self._mentions[modifier] = extract.mention_table(self.structured, self.snapshot.documents,
                                                             self.config, modifier)
        return self._mentions[modifier]

    @cached_property
    def attempts(self) -> DataFrame:
        return extract.attempts(self.structured, self.snapshot.documents, self.config, self.reader)

    def silver(self, modifier: str = MODIFIER) -> DataFrame:
        return silver.comparisons(self.linked, self.snapshot.documents, self.config, modifier)

    # -- jobs -------------------------------------------------------------------------
    @cached_property
    def episode_members(self) -> DataFrame:
        return episodes.members(self.structured)

    @cached_property
    def episodes(self) -> DataFrame:
        return episodes.number(episodes.episodes(self.episode_members))

    def ablation(self, definition: str) -> DataFrame:
        return ablation.staged_verdicts(self.snapshot, self.config, self.definitions[definition])

    def compare(self, a: str, b: str, scope: str) -> DataFrame:
        """Two definitions on the same records, in one pass."""
        compare.require_scope(scope)
        return compare.case_changes(evaluate.judge_both(
            self.records, self.definitions[a], self.definitions[b], self.config,
            self.snapshot.ex))

    def flat(self, modifier: str = MODIFIER) -> DataFrame:
        return retrieval.flat_records(self.records, modifier)

    def retrieve(self, definition: str | None = None, **filters) -> DataFrame:
        flat = self.flat()
        if definition:
            flat = retrieval.attach_verdicts(flat, self.assignments(definition))
        return retrieval.retrieve(flat, self.config, **filters)

    @cached_property
    def text_index(self) -> text_search.TextIndex:
        """The inverted index of the documents, written at its first use."""
        return text_search.build(self.snapshot.documents)

    def discover(self, text: str | None = None, **filters) -> DataFrame:
        return retrieval.discover(self.mentions(), self.text_index if text else None, text=text, **filters)

    def evidence_package(self, definition: str, results_dir: str, runs_dir: str,
                         question: str = "", studies: Sequence[str] | None = None) -> dict:
        """Everything one bound run reports: metadata first, then numbers, then the trace."""
        d = self.definitions[definition]
        support = {m.name: self.supportability(m.name) for m in d.modifiers}
        manifest, assignments = runs.execute(self, d, results_dir, runs_dir, studies=studies,
                                             question=question, actor="agent")
        recs = aggregates.study_filter(self.records, studies)
        chain = trace.trace_number(
            assignments, aggregates.study_filter(self.attributes, studies), recs, manifest,
            "case count", manifest["counts_by_verdict"].get("case", 0))
        return {"manifest": manifest, "supportability": support,
                "cohort": aggregates.cohort_report(assignments),
                "denominators": aggregates.denominators(assignments, overall=True),
                "exposure": aggregates.exposure_timing(recs),
                "covariates": aggregates.covariates(self.snapshot.cohort(studies),
                                                    self.snapshot.dm),
                "trace": chain}

    def evaluation(self, definition: str, holdout: Sequence[str] | None = None,
                   modifier: str | None = None) -> DataFrame:
        """The full evaluation as one long table (section, key, metric, value).

        The judged records, the answers, the comparison and the ablation are each read by
        several sections, so they are written once; records are read and judged in one pass.
        ``modifier`` is the first one that the definition asks for, unless named.
        """
        d = self.definitions[definition]
        modifier = modifier or next((m.name for m in d.modifiers), MODIFIER)
        gold = written(self.snapshot.gold().select(
            "source_record_id", "truth_id", "cohort", "readable", "true_verdict", "verdict_if_readable",
            "structured_assertion", "text_assertion", "true_availability"), "evaluation-gold")
        judged = written(self._judged(d, modifier), "evaluation-judged")
        scoped = evaluate.in_concept_set(judged, d, self.config)
        assigned = scoped.select("source_record_id", "subject_id", "study_id", "profile", "verdict",
                                 F.lit(None).cast("string").alias("reason"))
        parts = []

        def add(section: str, df: DataFrame, *keys: str) -> None:
            metrics = [c for c in df.columns if c not in keys]
            key = F.concat_ws("/", *keys) if keys else F.lit("ALL")
            parts.append(df.select(F.lit(section).alias("section"), key.alias("key"), F.explode(
                F.array(*[F.struct(F.lit(m).alias("metric"),
                                   F.col(m).cast("double").alias("value")) for m in metrics]))
                .alias("x")).select("section", "key", "x.metric", "x.value"))

        add("phenotype", scoring.case_metrics(scoring.phenotype_cells(assigned, gold), "scope",
                                              "key"), "scope", "key")
        add("denominators", aggregates.denominators(assigned, overall=True).drop("profile"),
            "study_id")
        read = F.create_map(F.lit(modifier), F.struct(
            "assertion", "availability", F.lit(None).cast("string").alias("note")))
        rows = scoring.assertion_rows(judged.withColumn("modifiers", read), gold, modifier)
        add("assertion", scoring.assertion_summary(scoring.assertion_cells(rows)))
        held = scoring.holdout_split(self.config, holdout)
        moved = written(scoring.case_metrics(scoring.holdout_cells(assigned, gold, held), "scope", "key"),
                        "evaluation-holdout")
        add("holdout", moved, "scope", "key")
        add("holdout_drop", scoring.holdout_drop(moved))
        add("invariance", scoring.invariance(scoring.truth_agreement(
            scoring.renderings(assigned, gold))))
        compared = written(self.silver(modifier), "evaluation-silver")
        add("silver", silver.metrics(compared), "scope", "key")
        add("calibration", silver.calibration(compared))
        staged = written(ablation.with_answers(scoped, self.snapshot) if self.reader is None
                         else self.ablation(definition), "evaluation-ablation")
        add("ablation", ablation.stage_metrics(staged).drop("position"), "stage")
        add("increment", ablation.increments(staged).select(
            "to_stage", "added_cases", "added_correct", "precision_on_added", "relative_gain"),
            "to_stage")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _judged(self, d: Definition, modifier: str) -> DataFrame:
        """Every record once: its verdict, what one modifier says and, read by the rules, its verdict per stage.

        Verdicts are those of the definition whether a record is in its scope or not. Stages and the
        records themselves are columns over one reading; no finding, reason, note or span is built.
        """
        maps = {"verdict": "modifiers"}
        with attrs.carrying(("assertion", "method", "confidence", "evidence")):
            if self.reader is None:
                staged = ablation.staged_records(self.snapshot, self.config)
                recs = staged.withColumn("modifiers", extract.filled_modifiers(self.config, True))
                maps |= ablation.stage_maps()
            else:
                recs = self._read()
        said = F.col("modifiers")[modifier]
        return evaluate.judge(
            evaluate.with_dose(recs, d, self.snapshot.ex), d, maps, "record_id", "source_record_id", "subject_id",
            "study_id", "profile", "concept_id", said["availability"].alias("availability"),
            said["assertion"].alias("assertion"))

    def reproducible(self) -> bool:
        """Normalize and read twice from fresh plans; equal fingerprints mean equal content."""
        def run() -> str:
            fresh = Trial(self.snapshot, self.config, self.definitions, self.reader)
            return runs.results_hash(fresh.assignments("cutaneous_mucosal.v2")).first()[0]
        return run() == run()

    def summary(self) -> DataFrame:
        """Snapshot counts beside the versions that read them."""
        return self.snapshot.summary().select(
            "*", F.lit(self.config.normalizer_version).alias("normalizer_version"),
            F.lit(self.config.extractor_version).alias("extractor_version"),
            F.lit(self.config.target_version).alias("dictionary_target"),
            F.lit(self.backend).alias("backend"))
