"""Registered queries against their plain SQL restatements."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from cohortloom.plans.oracle import ORACLE
from cohortloom.plans.queries import QUERIES
from conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# the driver compares every query; these cover each family and stay quick
QUICK = ["snapshot_fingerprint", "code_reconciliation", "codelist_readings",
         "seriousness_criteria", "structured_modifiers", "exposure_offsets", "sentence_counts",
         "folded_spelling", "event_mentions", "term_assertions", "structured_incidence",
         "narrative_verdicts", "graded_toxicity_verdicts", "cumulative_dose", "silver_calibration",
         "dose_increases", "latest_anchor", "episode_table", "document_search", "dense_rerank"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.10g}"
    return str(v)


def test_every_query_but_the_declared_ones_has_a_twin():
    assert set(QUERIES) - set(ORACLE) == {"results_hash", "number_trace"}
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
