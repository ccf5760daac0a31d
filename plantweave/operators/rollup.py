"""Rollups of scored places to parents, regions and states."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import positions


def sweep(df: DataFrame, score: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, passed) in one pass over the rows."""
    counts = df.agg(*(F.count_if(score >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("passed")) for i, t in enumerate(thresholds)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent non-null value; of equals the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counts.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def live_scores(df: DataFrame, weights: Mapping[str, float], out: str = "live_score") -> DataFrame:
    """Adds the score under weights that are brought to a sum of 1 (all zero: divided by 1), missing signals as 0,
    rounded half up to one digit."""
    total = sum(weights.values()) or 1
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.coalesce(F.col(c), F.lit(0.0)) * (w / total)
    return df.withColumn(out, F.floor(score * 10 + 0.5) / 10)


def rolled_up(df: DataFrame, parent: str, passes: Column, status: Column, amount: Column) -> DataFrame:
    return df.groupBy(parent).agg(
        F.count(F.lit(1)).alias("places"),
        F.count_if(passes).alias("qualified"),
        F.round(F.sum(F.when(passes, amount).otherwise(0.0)), 2).alias("amount"),
        F.round(F.sum(F.when(passes & (status == "untouched"), amount).otherwise(0.0)), 2).alias("untouched_amount"),
    )


def region_top(df: DataFrame, region: str, parent: str, amount: str, k: int = 5) -> DataFrame:
    """(region, parents, amount, top): totals and the k greatest parents of each region, greatest first."""
    parents = df.groupBy(region, parent).agg(F.round(F.sum(amount), 2).alias("a"))
    w = Window.partitionBy(region).orderBy(F.desc("a"), parent)
    top = parents.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    names = top.groupBy(region).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", parent))), lambda x: x[parent]).alias("top"))
    return parents.groupBy(region).agg(F.count(F.lit(1)).alias("parents"), F.round(F.sum("a"), 2).alias("amount")).join(names, region)


def churn(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(moved): how many positions hold another key when ranked by ``after`` instead of ``before``."""
    a = positions(df.select(key, before), [F.desc(before), F.col(key)], "pos")
    b = positions(df.select(F.col(key).alias("other"), after), [F.desc(after), F.col("other")], "pos")
    return a.join(b, "pos").agg(F.count_if(F.col(key) != F.col("other")).alias("moved"))
