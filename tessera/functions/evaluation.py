"""Accuracies, deltas and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    """Accuracy in total and by each column alone, in one pass: (by..., correct, total, accuracy); nulls of the others."""
    sets = [[], *([c] for c in by)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("total"), F.grouping_id().alias("level_id")).withColumn("accuracy", F.round(F.col("n_correct") / F.col("total"), 6))


def deltas(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Accuracy of two runs side by side, and how much the second gained."""
    return a.select(by, F.col("accuracy").alias("base")).join(b.select(by, F.col("accuracy").alias("tuned")), by).withColumn("delta", F.round(F.col("tuned") - F.col("base"), 6))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Rows of each value of a column, and their part of all rows."""
    total = df.count()
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.lit(total), 6))


def lengths(a: Column, b: Column) -> list[Column]:
    """Median and mean lengths of two texts, their mean difference, and the share of shorter firsts."""
    x, y = F.length(a), F.length(b)
    return [F.median(x).alias("median_chosen"), F.median(y).alias("median_rejected"), F.round(F.avg(x), 4).alias("mean_chosen"), F.round(F.avg(y), 4).alias("mean_rejected"), F.round(F.avg(x - y), 4).alias("mean_diff"), F.round(F.avg((x < y).cast("double")), 6).alias("share_shorter")]


def solve_rate(df: DataFrame, question: str, correct: str, gate: float = 5.0) -> DataFrame:
    """Questions solved by any sample in per cent, and whether that reaches the gate."""
    per = df.groupBy(question).agg(F.bool_or(correct).alias("solved"))
    return per.agg(F.count("*").alias("questions"), F.count_if("solved").alias("n_solved"), F.round(100 * F.avg(F.col("solved").cast("double")), 4).alias("rate")).withColumn("passed", F.col("rate") >= gate)


def softmax_shares(df: DataFrame, group: str, reward: str, beta: float) -> DataFrame:
    """``df`` with weight, exp(reward / beta) over its group's sum, stable by the group's maximum.

    Group values are aggregates joined back, so that a hot group is split by the join instead of sorted.
    """
    top = df.groupBy(group).agg(F.max(reward).alias("_top"))
    shifted = df.join(top, group).withColumn("_e", F.exp((F.col(reward) - F.col("_top")) / beta))
    sums = shifted.groupBy(group).agg(F.sum("_e").alias("_sum"))
    return shifted.join(sums, group).withColumn("weight", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")
