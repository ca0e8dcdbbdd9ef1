"""Cohort retrieval on exact filters, and text search whose results stay candidates."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ConfigError, TrialConfig
from ..functions.text import quoted
from ..sources.snapshot import exists

K1, B = 1.2, 0.75
INDEX_SCHEMA_VERSION = "1"
TOKEN = r"(?U)[\p{L}\p{N}]+"


class CandidateInCohort(RuntimeError):
    """Search results were about to be used as a cohort."""


# -- flat tables ------------------------------------------------------------------

def flat_records(recs: DataFrame, modifier: str) -> DataFrame:
    """Typed flat columns of the retrieval table; verdict columns start empty."""
    a, coded = F.col("modifiers")[modifier], F.col("coded_event")
    return recs.select(
        "record_id", "source_record_id", "study_id", "subject_id", "profile",
        F.col("concept_id").alias("concept"), coded["code"].alias("code"),
        coded["dictionary_version"].alias("dictionary_version"),
        coded["reconciliation"].alias("reconciliation"), F.lit(modifier).alias("modifier"),
        a["assertion"].alias("assertion"),
        F.coalesce(a["availability"], F.lit("unresolved")).alias("availability"),
        a["value"].alias("value"), a["method"].alias("method"),
        a["source_variable"].alias("source_variable"), a["confidence"].alias("confidence"),
        F.col("severity.value").alias("severity"), F.col("grade.value").alias("grade"),
        F.col("exposure_relation.value").alias("exposure_offset_days"),
        F.col("onset.value").alias("onset"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("string").alias("definition_id"),
        F.lit(None).cast("int").alias("definition_version"),
        F.coalesce("reported_term.value", F.lit("")).alias("reported_term"))


def attach_verdicts(flat: DataFrame, assignments: DataFrame) -> DataFrame:
    """Verdicts written onto the flat table; the newest definition written wins."""
    new = assignments.select("record_id", *[F.col(c).alias(f"new_{c}") for c in (
        "verdict", "definition_id", "definition_version")])
    joined = flat.join(new, "record_id", "left")
    written = F.col("new_verdict").isNotNull()
    return joined.select(*[
        F.when(written, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        if c in ("verdict", "definition_id", "definition_version") else F.col(c)
        for c in flat.columns])


def text_index(documents: DataFrame) -> DataFrame:
    """Searchable bodies with their token counts. Reported terms are not among them."""
    return documents.select("doc_id", "kind", folded(F.col("full_text")).alias("body")) \
        .withColumn("n_tokens", F.regexp_count("body", F.lit(TOKEN)))


def build_index(path: str, flat: DataFrame, mentions: DataFrame, documents: DataFrame,
                meta: dict[str, str]) -> None:
    """Write the retrieval tables; the version row goes last, so a torn build is stale."""
    spark = flat.sparkSession
    flat.write.mode("overwrite").partitionBy("study_id").parquet(f"{path}/records")
    mentions.write.mode("overwrite").partitionBy("study_id").parquet(f"{path}/mentions")
    text_index(documents).write.mode("overwrite").parquet(f"{path}/text_index")
    spark.createDataFrame([{"schema_version": INDEX_SCHEMA_VERSION, **meta}]).coalesce(1).write.mode(
        "overwrite").json(f"{path}/meta")


def update_verdicts(path: str, assignments: DataFrame) -> str:
    """Write the newest flat table again with these verdicts in it; returns the new location.

    A row keeps what earlier definitions said of it unless this one judges it too. Each
    version has a folder of its own and the pointer to it is appended last, so readers of an
    earlier version are not disturbed and a torn write is never read.
    """
    spark = assignments.sparkSession
    version, newest = current_records(spark, path)
    target = f"{path}/records_v{version + 1}"
    attach_verdicts(spark.read.parquet(newest), assignments).write.mode(
        "overwrite").partitionBy("study_id").parquet(target)
    spark.createDataFrame([(version + 1, target)], "version int, location string").coalesce(1) \
        .write.mode("append").json(f"{path}/record_versions")
    return target


def current_records(spark: SparkSession, path: str) -> tuple[int, str]:
    """Version and location of the flat table that was written last."""
    if not exists(spark, f"{path}/record_versions"):
        return 0, f"{path}/records"
    last = spark.read.schema("version int, location string").json(f"{path}/record_versions") \
        .orderBy(F.desc("version")).first()
    return (last["version"], last["location"]) if last else (0, f"{path}/records")


def stale(meta: DataFrame, extractor: str, normalizer: str) -> DataFrame:
    """Version differences of a built index; no rows means it is current."""
    current = {"schema_version": INDEX_SCHEMA_VERSION, "extractor_version": extractor,
               "normalizer_version": normalizer}
    checks = [F.when(~F.col(k).eqNullSafe(F.lit(v)), F.struct(
        F.lit(k).alias("part"), F.col(k).alias("built_with"), F.lit(v).alias("now")))
        for k, v in current.items()]
    return meta.select(F.explode(F.array_compact(F.array(*checks))).alias("d")).select("d.*")


def stored_studies(flat: DataFrame) -> DataFrame:
    return flat.select("study_id").distinct()


# -- the precise path ----------------------------------------------------------------

LIST_FILTERS = ("assertion", "availability", "value", "method", "profile", "verdict",
                "reconciliation")


def retrieve(flat: DataFrame, config: TrialConfig, *, concept: str | None = None,
             group: str | None = None, studies: Sequence[str] | None = None,
             window: tuple[int, int] | None = None, definition_id: str | None = None,
             definition_version: int | None = None, top_k: int | None = None, **lists
             ) -> DataFrame:
    """Cohort-eligible rows under exact filters, ordered by record id.

    Assertion and availability are separate filters: a documented negative and a
    variable nobody collected are different populations.
    """
    unknown = set(lists) - set(LIST_FILTERS)
    if unknown:
        raise ConfigError(f"unknown filters {sorted(unknown)}")
    wanted = config.expand([c for c in (concept,) if c], strict=True)
    if group is not None:
        if group not in config.groups:
            raise ConfigError(f"unknown concept group {group!r}")
        wanted = sorted({*wanted, *config.groups[group]})
    rows = flat
    if wanted:
        rows = rows.filter(F.col("concept").isin(*wanted))
    if studies:
        rows = rows.filter(F.col("study_id").isin(*studies))
    for name in LIST_FILTERS:
        if lists.get(name):
            rows = rows.filter(F.col(name).isin(*lists[name]))
    if window is not None:
        rows = rows.filter(F.col("exposure_offset_days").between(*window))
    if definition_id:
        rows = rows.filter(F.col("definition_id") == definition_id)
    if definition_version is not None:
        rows = rows.filter(F.col("definition_version") == definition_version)
    rows = rows.withColumn("definition", F.concat(
        "definition_id", F.lit(".v"), "definition_version")).orderBy("record_id")
    return rows.limit(top_k) if top_k else rows


def as_cohort(df: DataFrame) -> DataFrame:
    """Pass exact results through; refuse anything carrying the candidate mark."""
    if "candidate" in df.columns:
        raise CandidateInCohort("search results are candidates; a cohort is built from exact "
                                "filters, or after adjudication")
    return df


# -- the search path -------------------------------------------------------------------

class Term(NamedTuple):
    """Words that must stand one after the other; the last may be the beginning of a word."""

    words: tuple[str, ...]
    prefix: bool = False
    banned: bool = False

    @property
    def pattern(self) -> str:
        body = r"[^\p{L}\p{N}]+".join(self.words)
        return rf"(?U)(?<![\p{{L}}\p{{N}}]){body}" + ("" if self.prefix else r"(?![\p{L}\p{N}])")


def query_terms(text: str) -> list[Term]:
    """Distinct terms of a query: words, "phrases", beginnings* and -excluded ones.

    All but the excluded ones must occur. Case and diacritics do not count.
    """
    terms: list[Term] = []
    for sign, phrase, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        words = tuple(re.findall(r"[^\W_]+", plain(phrase or bare)))
        if not words:
            continue
        # punctuation inside a bare word parts it into words of their own
        parts = [words] if phrase else [(w,) for w in words]
        for part in parts:
            term = Term(part, not phrase and bare.endswith("*") and part is parts[-1], bool(sign))
            if term not in terms:
                terms.append(term)
    return terms


#: Combining marks behind a Latin letter.
_MARKS = "(?<=[a-z\u00df-\u02af\u1e00-\u1eff])[\u0300-\u036f]+"


def _marked_letters() -> tuple[str, str]:
    """Latin letters that are one base letter with marks, and those base letters."""
    found = [(c, "".join(d for d in unicodedata.normalize("NFD", c) if not unicodedata.combining(d)))
             for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))]
    pairs = [(c, base) for c, base in found if len(base) == 1 and base != c and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def plain(text: str) -> str:
    """A query as it is searched: lower case, Latin letters without diacritics; other scripts keep theirs."""
    return re.sub(_MARKS, "", text.lower().translate(str.maketrans(*_marked_letters())))


def folded(column: Column) -> Column:
    """A body as it is searched, by the rule of ``plain``."""
    return F.regexp_replace(F.translate(F.lower(column), *_marked_letters()), _MARKS, "")


def _term_count(body: str, term: Term) -> Column:
    return F.expr(f"regexp_count(`{body}`, {quoted(term.pattern)})")


def bm25(index: DataFrame, text: str, id_column: str = "doc_id") -> DataFrame:
    """BM25 of documents holding every query term; lower is better, as the score is negated.

    Document count, mean length and document frequencies are one global aggregate
    whose single row is broadcast. Terms are counted in place; no token is shuffled.
    """
    terms = query_terms(text)
    if all(t.banned for t in terms):
        raise ValueError("the query holds no term")
    counts = {f"tf_{i}": _term_count("body", t) for i, t in enumerate(terms)}
    wanted = [n for n, t in zip(counts, terms) if not t.banned]
    counted = index.select(id_column, F.col("n_tokens").alias("dl"),
                           *[c.alias(n) for n, c in counts.items()])
    stats = counted.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("mean_dl"),
        *[F.count_if(F.col(n) > 0).alias(f"d{n}") for n in wanted])
    fits = F.lit(True)
    for n in counts:
        fits = fits & ((F.col(n) > 0) if n in wanted else (F.col(n) == 0))
    scored = counted.filter(fits).crossJoin(F.broadcast(stats))  # one row of statistics
    total = F.lit(0.0)
    for n in wanted:
        n_docs, df, tf = F.col("n_docs"), F.col(f"d{n}"), F.col(n)
        idf = F.log((n_docs - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        total = total + idf * (tf * (K1 + 1)) / (
            tf + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    return scored.select(id_column, (-total).alias("score"))


def discover(mentions: DataFrame, index=None, *, text: str | None = None,
             modifier: Sequence[str] | None = None, assertion: Sequence[str] | None = None,
             value: Sequence[str] | None = None, studies: Sequence[str] | None = None,
             profile: Sequence[str] | None = None, top_k: int | None = None) -> DataFrame:
    """Mentions in prose, best documents first. Every row is marked a candidate.

    ``index`` is an index of ``text_search.build`` or, for bodies without one, ``text_index``.
    """
    rows = mentions
    for column, wanted in (("modifier", modifier), ("assertion", assertion), ("value", value),
                           ("study_id", studies), ("profile", profile)):
        if wanted:
            rows = rows.filter(F.col(column).isin(*wanted))
    if text:
        from . import text_search  # it builds on the terms and folding of this module
        scored = bm25(index, text) if isinstance(index, DataFrame) else text_search.bm25(index, text)
        rows = rows.join(scored, "doc_id").withColumn("candidate", F.lit(True))
        rows = rows.orderBy("score", "mention_id")
    else:
        rows = rows.withColumns({"score": F.lit(0.0), "candidate": F.lit(True)}).orderBy(
            "mention_id")
    return rows.limit(top_k) if top_k else rows


def rerank(candidates: DataFrame, vectors: DataFrame, query: Sequence[float] | DataFrame,
           key: str = "mention_id", top_k: int | None = None) -> DataFrame:
    """Reorder candidates by the dot product of their vector with the query vector.

    ``vectors`` has ``key`` and ``embedding``. The query is a literal vector, or a frame of
    stated queries with ``query_id`` and ``query``: every query then ranks all candidates and
    ``top_k`` holds for each. A frame without ``query_id`` must have one row.
    """
    rows = candidates.join(vectors.select(key, "embedding"), key)
    by = []
    if isinstance(query, DataFrame):
        if "query_id" in query.columns:
            by, asked = ["query_id"], query.select("query_id", "query")
        else:
            whole = query.agg(F.any_value("query").alias("query"), F.count(F.lit(1)).alias("n"))
            asked = whole.select(F.when(F.col("n") == 1, F.col("query")).otherwise(F.raise_error(
                F.lit("several query rows need a query_id"))).alias("query"))
        rows = rows.crossJoin(asked)  # a stated set of queries against the candidates
    else:
        rows = rows.withColumn("query", F.array(*[F.lit(float(q)) for q in query]))
    products = F.zip_with("embedding", "query",
                          lambda a, b: a.cast("double") * b.cast("double"))
    scored = rows.withColumn("score", F.aggregate(
        products, F.lit(0.0), lambda acc, x: acc + x)).drop("embedding", "query")
    if by and top_k:  # Spark cuts such a rank inside each task before it shuffles
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
        return scored.withColumn("place", rank).filter(F.col("place") <= top_k).drop("place") \
            .orderBy(*by, F.desc("score"), key)
    scored = scored.orderBy(*by, F.desc("score"), key)
    return scored.limit(top_k) if top_k else scored
