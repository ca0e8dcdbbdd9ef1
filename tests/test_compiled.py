"""What decides whether the steps that every record passes are compiled or interpreted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import attrs
from cohortloom.plans.queries import QUERIES, trial

SMALL = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["provenance_audit", "narrative_verdicts", "definition_comparison",
                                  "term_only_verdicts"])
def test_no_generator_builds_what_it_explodes(spark, name):
    plan = optimized(QUERIES[name](spark, SMALL))
    generators = [line for line in plan.splitlines() if "Generate explode" in line]
    assert not [line for line in generators if "explode(array(struct(" in line or "explode(array(named_struct(" in line]
    # the test for empty arrays would evaluate the array once more
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(array(" in line]


def test_long_methods_are_left_to_single_operators(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    trial(spark, SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_computed_keeps_rows_with_null_answers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    rows = attrs.computed(df, "s", F.when(F.col("v").isNotNull(), F.struct("v"))).orderBy("k").collect()
    assert [(r.k, r.s and r.s.v) for r in rows] == [(1, "a"), (2, None)]


def test_broken_invariants_are_counted_as_listed(spark):
    attributes = trial(spark, SMALL).attributes
    damaged = attributes.limit(400).withColumns({
        "method": F.when(F.col("name") == "grade", "guess").otherwise(F.col("method")),
        "assertion": F.when(F.col("name") == "onset", None).otherwise(F.col("assertion")),
        "availability": F.when(F.col("name") == "end", None).otherwise(F.col("availability")),
        "evidence": F.when(F.col("name") == "severity", F.slice("evidence", 1, 0)).otherwise(F.col("evidence"))})
    row = F.struct(*[F.col(c) for c in damaged.columns])
    counted = damaged.select(F.size(attrs.violations(row)).alias("listed"), attrs.n_violations(row).alias("counted"))
    rows = counted.collect()
    assert any(r.listed for r in rows)
    assert [r.listed for r in rows] == [r.counted for r in rows]


@pytest.mark.parametrize("name", ["attribute_counts", "attribute_predicates"])
def test_counted_attributes_carry_no_spans(spark, name):
    plan = optimized(QUERIES[name](spark, SMALL))
    above = plan.split("Generate explode(attributes", 1)[1].splitlines()[1]
    # the struct of an attribute holds what is counted, not its evidence
    assert "availability" in above and "evidence" not in above


def test_some_fields_of_attributes_are_those_of_all(spark):
    t = trial(spark, SMALL)
    fields = ("availability", "assertion", "method", "prior_availability")
    keys = ("record_id", "name")
    whole = t.attributes.limit(2000).select(*keys, *fields)
    some = t.attribute_fields(*fields).select(*keys, *fields)
    assert whole.exceptAll(some).count() == 0
    assert some.count() == t.attributes.count()
