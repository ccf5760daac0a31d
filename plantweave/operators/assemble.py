"""From clustered records to places and accounts: representatives, merged attributes, counters, notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble_places(members: DataFrame, keys: Sequence[str], order: str, first: Sequence[str], present: Sequence[str] = (), last: Sequence[str] = (), anyof: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each cluster (``keys``) of member rows: ``first`` columns of the first member in ``order`` even if null,
    ``present`` columns of the first member that has them, ``last`` of the last that has them, ``anyof`` conditions as
    true if any member meets them, and ``n_members``, ``member_ids`` in order and sorted distinct ``sources``.

    ``members`` has source and member_id besides. Null keys are one cluster. ``order`` should be unique in a cluster; of
    equals any counts. Only the ids of one cluster are collected, all else is folded before the shuffle.
    """
    out = [F.min_by(F.col(c), F.col(order)).alias(c) for c in first]
    out += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in present]
    out += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    out += [F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in (anyof or {}).items()]
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("member_id").alias("m")))), lambda x: x["m"])
    return members.groupBy(*keys).agg(*out, F.count(F.lit(1)).alias("n_members"), ids.alias("member_ids"), F.array_sort(F.collect_set("source")).alias("sources"))


def first_reason(reasons: Mapping[str, Column], order: str) -> Column:
    """The reason of the first member in ``order`` that meets one of the conditions, which are tried in their order."""
    own = F.coalesce(*(F.when(c, F.lit(name)) for name, c in reasons.items()))
    return F.min_by(own, F.when(own.isNotNull(), F.col(order)))


def assemble_accounts(places: DataFrame, pending: DataFrame, account: str, name: str, order: str, qualified: Column, untouched: Column, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each account that has a place: its name (``overrides``, else that of the first place), counts of places, of
    ``qualified`` ones, of ``qualified`` and ``untouched`` ones, and of its rows in ``pending`` (0 if none)."""
    known = F.create_map(*(F.lit(x) for kv in (overrides or {}).items() for x in kv)) if overrides else F.create_map().cast("map<string,string>")
    ok = F.coalesce(qualified, F.lit(False))
    out = places.groupBy(account).agg(
        F.min_by(F.col(name), F.col(order)).alias("__name"),
        F.count(F.lit(1)).alias("places"),
        F.count_if(ok).alias("qualified"),
        F.count_if(ok & F.coalesce(untouched, F.lit(False))).alias("untouched"),
    )
    waiting = pending.groupBy(account).agg(F.count(F.lit(1)).alias("__n"))
    out = out.join(waiting, account, "left")
    return out.select(account, F.coalesce(known[F.col(account)], F.col("__name")).alias("name"), "places", "qualified", "untouched", F.coalesce("__n", F.lit(0)).alias("pending"))


def pattern_hits(df: DataFrame, account: str, name: Column, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(account, hits): which of the companies' patterns lead a name of each account, sorted; accounts without are left out."""
    from ..functions.text import leads_with

    hits = F.array_compact(F.array(*(F.when(F.greatest(*(leads_with(name, p) for p in own), F.lit(False)), company) for company, own in patterns.items())))
    found = df.select(account, F.explode(hits).alias("hit"))
    return found.groupBy(account).agg(F.array_sort(F.collect_set("hit")).alias("hits"))


def attribution_note(total: Column, n: Column, shared: Column) -> Column:
    """What the amounts of a place's city say about it: nothing on file, its own, or shared with other places there."""
    return F.when(n.isNull(), "no awards in this city").when(shared, F.concat(n.cast("string"), F.lit(" awards shared by places in this city"))).otherwise(
        F.concat(n.cast("string"), F.lit(" awards, "), F.format_number(total, 0))
    )


def capacity(headcount: Column, ratio: Column, per_unit: float, cap: Column) -> Column:
    """Whole units for the share of the headcount, not more than ``cap``; null without a headcount."""
    return F.when(headcount.isNotNull(), F.least(F.floor(headcount * ratio / per_unit), cap))


def filled(df: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str], missing: Column) -> DataFrame:
    """``df`` with ``columns`` taken from ``lookup`` (one row a key) where ``missing`` holds, and ``filled``, if so."""
    other = lookup.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__v_{c}") for c in columns))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    got = df.withColumn("__miss", F.coalesce(missing, F.lit(True))).join(other, on & F.col("__miss"), "left")
    took = F.col("__miss") & F.col(f"__v_{columns[0]}").isNotNull()
    new = {c: F.when(F.col("__miss"), F.col(f"__v_{c}")).otherwise(F.col(c)) for c in columns}
    return got.withColumns({**new, "filled": took}).select(*df.columns, "filled")
