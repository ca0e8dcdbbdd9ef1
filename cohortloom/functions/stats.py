"""Metric columns: ratios with zero guards, half-even rounding, precision/recall/F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """``top / bottom`` as a double; ``empty`` when the bottom is zero."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def round4(value: Column) -> Column:
    return F.bround(value, 4)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Counts and unrounded precision, recall and F1."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (tp + fn).alias("support"),
            (tp + fp).alias("predicted"), precision.alias("precision"), recall.alias("recall"),
            f1(precision, recall).alias("f1")]


def slot_counts(gold: Column, predicted: Column) -> list[Column]:
    """TP, FP, FN of one single-valued slot; a wrong value is both FP and FN."""
    def filled(c: Column) -> Column:
        return c.isNotNull() & (c != "")
    hit = filled(gold) & filled(predicted) & (gold == predicted)
    return [F.coalesce(flag, F.lit(False)).cast("int").alias(name) for name, flag in (
        ("tp", hit), ("fp", filled(predicted) & ~F.coalesce(hit, F.lit(False))),
        ("fn", filled(gold) & ~F.coalesce(hit, F.lit(False))))]


def set_counts(gold: Column, predicted: Column) -> list[Column]:
    """TP, FP, FN of two array-valued slots compared as sets."""
    return [F.size(F.array_intersect(gold, predicted)).alias("tp"),
            F.size(F.array_except(predicted, gold)).alias("fp"),
            F.size(F.array_except(gold, predicted)).alias("fn")]


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def confusion(df: DataFrame, gold: str, predicted: str, *by: str) -> DataFrame:
    """Cell counts of a gold by predicted matrix."""
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def per_label(cells: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 per label, from confusion cells."""
    sides = cells.select(*by, "n", F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.lit("gold").alias("side")),
        F.struct(F.col("predicted").alias("label"), F.lit("predicted").alias("side")),
    )).alias("s"), (F.col("gold") == F.col("predicted")).alias("hit"))
    counted = sides.groupBy(*by, F.col("s.label").alias("label")).agg(*[
        F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name) for name, cond in (
            ("tp", F.col("hit") & (F.col("s.side") == "gold")),
            ("fp", ~F.col("hit") & (F.col("s.side") == "predicted")),
            ("fn", ~F.col("hit") & (F.col("s.side") == "gold")))])
    return counted.select(*by, "label", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
