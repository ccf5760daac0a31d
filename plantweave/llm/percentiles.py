"""Percentiles of very large numeric columns (problem 5): cumulative frequencies over a range-sorted key.

A column is reduced to group-value counts, in parts (days) that can be kept and merged by adding counts. With
``relative_error`` 0 the values stay as they are and percentiles are exact; above 0 values are first rounded to the
representative of a logarithmic bucket, which bounds the number of distinct values and the error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def bucketed(value: Column, relative_error: float) -> Column:
    """The value, or with an error the middle of its logarithmic bucket: at most ``relative_error`` * |value| away.
    Zero stays zero; the sign is kept; infinite values stay."""
    if not relative_error:
        return value
    base = (1 + relative_error) / (1 - relative_error)
    k = F.ceil(F.log(F.abs(value)) / math.log(base))
    middle = 2 * F.pow(F.lit(base), k) / (base + 1)
    finite = F.abs(value) < float("inf")
    return F.when((value == 0) | ~finite, value).otherwise(F.signum(value) * middle)


def value_counts(df: DataFrame, group: str, columns: Sequence[str], part: str | None = None, relative_error: float = 0.0) -> DataFrame:
    """(measure, grp, part, value, n): the summary that merges by adding n. Null and NaN don't count, zero does.

    All columns are read in one pass: a row becomes at most one entry a column, and entries are counted before they
    are shuffled, so a group that holds a third of all rows costs one row a distinct value.
    """
    entries = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns))
    kept = df.select(F.col(group).cast("string").alias("grp"), (F.to_date(part) if part else F.lit(None).cast("date")).alias("part"), F.explode(entries).alias("e"))
    kept = kept.select("grp", "part", "e.measure", "e.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    kept = kept.withColumn("value", bucketed(F.col("value"), relative_error) + 0.0)  # -0.0 and 0.0 are one value
    return kept.groupBy("measure", "grp", "part", "value").agg(F.count(F.lit(1)).alias("n"))


def merged(*summaries: DataFrame) -> DataFrame:
    """One summary of several, of different days or partitions."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy("measure", "grp", "part", "value").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, quantiles: Sequence[float] = QUANTILES, parts: int = 64) -> DataFrame:
    """(measure, grp, quantile, value, n): the smallest value whose cumulative count reaches ceil(quantile * n).

    The counts are range-sorted by (measure, grp, value); each of the ``parts`` ranges has its own running sums, and
    the totals of the ranges before it in the same group are added as its offset, so a group of any size is spread
    over many tasks. Groups without values have no rows; a null group is a group. The value is a member of the column
    (with an error in the summary: within that relative error of it); the rank is exact in both cases.
    """
    days = summary.groupBy("measure", "grp", "value").agg(F.sum("n").alias("n"))
    ordered = days.repartitionByRange(parts, "measure", F.col("grp").asc_nulls_first(), "value").withColumn("range", F.spark_partition_id())
    ordered = cut(ordered)
    totals = ordered.groupBy("measure", "grp", "range").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("measure", "grp").orderBy("range")
    whole = Window.partitionBy("measure", "grp")
    totals = totals.select(
        "measure", F.col("grp").alias("g"), "range", (F.sum("t").over(before) - F.col("t")).alias("skip"), F.sum("t").over(whole).alias("total"), (F.sum("t").over(before)).alias("upto")
    )
    ranks = F.array(*(F.struct(F.lit(float(q)).alias("quantile"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("total") - 1e-9)).alias("rank")) for q in quantiles))
    targets = totals.withColumn("q", F.explode(ranks)).filter((F.col("q.rank") > F.col("skip")) & (F.col("q.rank") <= F.col("upto")))
    targets = targets.select(F.col("measure").alias("m"), "g", F.col("range").alias("r"), "skip", "total", "q.quantile", "q.rank")
    running = Window.partitionBy("measure", "grp", "range").orderBy("value")
    sums = ordered.withColumn("cum", F.sum("n").over(running))
    on = (F.col("measure") == F.col("m")) & F.col("grp").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r"))
    hits = sums.join(targets, on).filter(F.col("cum") + F.col("skip") >= F.col("rank"))
    return hits.groupBy("measure", "grp", "quantile", "total").agg(F.min("value").alias("value")).select("measure", "grp", "quantile", "value", F.col("total").alias("n"))
