"""Building entity tables out of long, repeated or nested source rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_max(df: DataFrame, key: str, conditions: Mapping[str, Column], value: str) -> DataFrame:
    """One row a key with the greatest value under each condition; one pass, partial and final aggregation."""
    return df.groupBy(key).agg(*(F.max(F.when(c, F.col(value))).alias(n) for n, c in conditions.items()))


def distinct_lists(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(out))


def rule_struct(rules: Sequence[tuple[Column, Mapping[str, str]]]) -> Column:
    """The struct of the first rule that holds, else null."""
    out = None
    for when, fields in rules:
        made = F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))
        out = F.when(when, made) if out is None else out.when(when, made)
    return out


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key (nulls are one key): the last in ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def collapse_series(df: DataFrame, key: str, year: str, latest: Sequence[str], earliest: Sequence[str], series: Sequence[str]) -> DataFrame:
    """One row a key (rows without a key share one, without a series, as they may be many): ``latest`` columns of the last year even if null, ``earliest`` of the first,
    and the yearly ``series`` in order. Within a year ties are broken by the columns themselves, in their order."""
    tie = F.struct(F.col(year), *(F.col(c) for c in (*series, *latest, *earliest)))
    return df.groupBy(key).agg(
        *(F.max_by(F.col(c), tie).alias(c) for c in latest),
        *(F.min_by(F.col(c), tie).alias(c) for c in earliest),
        F.when(F.col(key).isNotNull(), F.array_sort(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(year, *series))))).alias("series"),
    )


def series_trend(series: Column, field: str, band: float = 0.05) -> Column:
    """Trend between the first and the last present value of a sorted series of structs."""
    from ..functions.stats import relative_change, trend

    known = F.filter(series, lambda x: x[field].isNotNull())
    first, last = F.try_element_at(known, F.lit(1))[field], F.try_element_at(known, F.lit(-1))[field]
    return F.when(F.size(known) >= 2, trend(relative_change(first, last), band)).otherwise("no_data")


def first_present(value: str, order: str) -> Column:
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def last_present(value: str, order: str) -> Column:
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def first_listed(codes: Column, lookup: Mapping[str, str]) -> Column:
    """The lookup's value of the first code it knows."""
    table = F.create_map(*(F.lit(x) for kv in lookup.items() for x in kv))
    return F.get(F.filter(F.transform(codes, lambda c: table[c]), lambda v: v.isNotNull()), F.lit(0))


def enrich_once(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cache rows stay; new keys are added."""
    return cache.unionByName(new.join(cache.select(key), key, "left_anti"), allowMissingColumns=True)


def attributed(places: DataFrame, amounts: DataFrame, group: str, keys: Sequence[str], amount: str) -> DataFrame:
    """``places`` with the summed amount of their group and keys (null keys meet null keys) and whether several places
    share it. Amounts are summed before the join."""
    clean = {k: F.upper(F.coalesce(F.col(k), F.lit(""))) for k in keys}
    sums = amounts.groupBy(F.col(group).alias("__g"), *(clean[k].alias(f"__{k}") for k in keys)).agg(
        F.sum(F.coalesce(F.col(amount), F.lit(0.0))).alias("total_amount"), F.count(F.lit(1)).alias("n_amounts")
    )
    counts = places.groupBy(F.col(group).alias("__g2"), *(clean[k].alias(f"__2{k}") for k in keys)).agg((F.count(F.lit(1)) > 1).alias("shared"))
    on, on2 = F.col(group) == F.col("__g"), F.col(group) == F.col("__g2")
    for k in keys:
        on, on2 = on & (clean[k] == F.col(f"__{k}")), on2 & (clean[k] == F.col(f"__2{k}"))
    return places.join(sums, on, "left").join(counts, on2, "left").drop("__g", "__g2", *(f"__{k}" for k in keys), *(f"__2{k}" for k in keys))
