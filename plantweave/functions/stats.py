"""Column and table functions on numbers: ranks, bands, interpolation, guarded ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import HOT_KEYS, checked_broadcast, cut

#: Rows of one value above which its rank is broadcast instead of joined by a shuffle.
HOT_ROWS = 20_000


def present(c: Column) -> Column:
    """The number, or null for NaN."""
    return F.when(~F.isnan(c), c)


def relative_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, (new - old) / old)


def trend(change: Column, band: float = 0.05) -> Column:
    """up, down, flat within the band (its ends included), or no_data."""
    return F.when(change.isNull(), "no_data").when(change > band, "up").when(change < -band, "down").otherwise("flat")


def rate(cases: Column, hours: Column, per: float = 200_000.0) -> Column:
    return F.when(hours > 0, cases * per / hours)


def band_score(value: Column, bands: Sequence[tuple[float | None, float]]) -> Column:
    """Score of the first band whose upper end isn't exceeded (None: no end); 0 for null."""
    out = F.when(value.isNull(), 0.0)
    for top, score in bands:
        out = out.when(F.lit(True) if top is None else value <= top, float(score))
    return out.otherwise(float(bands[-1][1]))


def interpolated(value: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, constant beyond the ends, rounded down."""
    p = sorted(points)
    out = F.when(value <= p[0][0], p[0][1])
    for (x0, y0), (x1, y1) in zip(p, p[1:]):
        out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return F.floor(out.otherwise(p[-1][1]))


def half_up(value: Column, digits: int = 1) -> Column:
    return F.floor(value * 10**digits + 0.5) / 10**digits


def capped(value: Column, top: float) -> Column:
    """Null if above ``top``."""
    return F.when(value <= top, value)


def first_estimate(*steps: tuple[str, Column], none: str = "no_estimate") -> tuple[Column, Column]:
    """(value, basis): the first step that is neither null nor zero; 0 and ``none`` if there is none."""
    value, basis = F.coalesce(*(F.nullif(c, F.lit(0.0)) for _, c in steps), F.lit(0.0)), None
    for name, c in steps:
        ok = F.coalesce(c, F.lit(0.0)) != 0
        basis = F.when(ok, name) if basis is None else basis.when(ok, name)
    return value, basis.otherwise(none)


def cumulative(counts: DataFrame, group: str, value: str, n: str, parts: int = 64) -> DataFrame:
    """``counts`` (one row a group and value) with ``below``, the count of smaller values of the group, and ``total``.

    Rows are range-sorted by group and value; each range has its own running sums, to which the totals of the group's
    earlier ranges are added. So a group may hold any share of the rows, or all of them, without being one task.
    """
    ranged = cut(counts.repartitionByRange(parts, F.col(group).asc_nulls_first(), F.col(value)).withColumn("__r", F.spark_partition_id()))
    whole = Window.partitionBy("__g")
    totals = ranged.groupBy(F.col(group).alias("__g"), F.col("__r").alias("__q")).agg(F.sum(n).alias("__t"))  # at most groups + parts rows
    totals = totals.select("__g", "__q", (F.sum("__t").over(whole.orderBy("__q")) - F.col("__t")).alias("__skip"), F.sum("__t").over(whole).alias("total"))
    placed = ranged.join(checked_broadcast(totals), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__r") == F.col("__q")))
    own = F.sum(n).over(Window.partitionBy(group, "__r").orderBy(value)) - F.col(n)
    return placed.withColumn("below", F.col("__skip") + own).drop("__g", "__q", "__r", "__skip")


def group_percentiles(df: DataFrame, wanted: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """Adds an average-rank percentile (0 to 100) for each (value, group, name): of the value within the group (None: the
    whole table); null where either is null. A group of one has percentile 0.

    All values are counted in one pass, before they are shuffled, and ranked in one range sort. The ranks come back by a
    join on (measure, group, value): rows without a value, however many, take no part in it, and values of over
    HOT_ROWS rows (zeros, ties) are answered by a broadcast of those few instead of meeting in one task.
    """
    keys = [(F.lit(k), F.coalesce(F.col(g).cast("string"), F.lit(None)) if g else F.lit(""), F.col(v).cast("double")) for k, (v, g, _) in enumerate(wanted)]
    entries = F.array(*(F.struct(m.alias("m"), g.alias("g"), (v + 0.0).alias("v")) for m, g, v in keys))
    long = df.select(F.explode(entries).alias("e")).select("e.*").filter("v is not null and g is not null")
    counts = long.groupBy("m", "g", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("mg", F.struct("m", "g"))
    ranked = cumulative(counts, "mg", "v", "c")
    pct = (F.col("below") + (F.col("c") - 1) / 2) / F.greatest(F.col("total") - 1, F.lit(1)) * 100
    ranked = cut(ranked.select("m", "g", "v", "c", pct.alias("p")))
    hot = F.broadcast(ranked.filter(F.col("c") > HOT_ROWS).orderBy(F.desc("c"), "m", "g", "v").limit(HOT_KEYS))
    for k, (_, _, name) in enumerate(wanted):
        g, v = keys[k][1], keys[k][2] + 0.0
        few = hot.filter(F.col("m") == k).select(F.col("g").alias("__hg"), F.col("v").alias("__hv"), F.col("p").alias("__hp"))
        df = df.join(few, (g == F.col("__hg")) & (v == F.col("__hv")), "left")
        # Rows that have no rank to look up are spread by a key that meets nothing.
        asks = F.col("__hp").isNull() & g.isNotNull() & v.isNotNull()
        df = df.withColumn("__k", F.when(asks, g).otherwise(F.concat(F.lit("\u0000"), (F.monotonically_increasing_id() % 997).cast("string"))))
        rest = ranked.filter(F.col("m") == k).select(F.col("g").alias("__g1"), F.col("v").alias("__v1"), F.col("p").alias("__p1"))
        df = df.join(rest, (F.col("__k") == F.col("__g1")) & (v == F.col("__v1")), "left").withColumn(name, F.coalesce("__hp", "__p1"))
        df = df.drop("__k", "__g1", "__v1", "__p1", "__hg", "__hv", "__hp")
    return df


def group_percentile(df: DataFrame, value: str, group: str | None, out: str) -> DataFrame:
    """``group_percentiles`` of one value."""
    return group_percentiles(df, [(value, group, out)])


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, n): the mean of the two middle values, from value counts, so that a group may hold any share of the
    rows. Null values and groups don't count."""
    counts = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    at = cumulative(counts, group, "__v", "__c")
    holds = lambda k: (F.col("below") <= k) & (F.col("below") + F.col("__c") > k)
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    got = at.filter(holds(lo) | holds(hi)).groupBy(group).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.max("total").alias("n"))
    return got.select(group, ((F.col("lo") + F.col("hi")) / 2).alias("median"), "n")


def strict_long(text: Column) -> Column:
    """The text as a whole number; any other text raises, null stays null."""
    number = text.try_cast("bigint")
    return F.when(text.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("bigint"))


def upper_median(df: DataFrame, group: str, value: str, at_least: int = 3) -> DataFrame:
    """(group, upper_median, n): of an even number of values the greater middle one; groups with fewer than
    ``at_least`` values are left out."""
    counts = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    middle = F.floor(F.col("total") / 2)
    at = cumulative(counts, group, "__v", "__c").filter((F.col("below") <= middle) & (F.col("below") + F.col("__c") > middle) & (F.col("total") >= at_least))
    return at.select(group, F.col("__v").alias("upper_median"), F.col("total").alias("n"))


def positions(df: DataFrame, order: Sequence[Column], out: str, parts: int = 64) -> DataFrame:
    """Adds the row number in ``order``, which must be total, without bringing all rows into one task."""
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__r", F.spark_partition_id()))
    totals = ranged.groupBy(F.col("__r").alias("__q")).agg(F.count(F.lit(1)).alias("__t"))  # at most ``parts`` rows
    totals = totals.select("__q", (F.sum("__t").over(Window.orderBy("__q")) - F.col("__t")).alias("__skip"))
    numbered = ranged.join(F.broadcast(totals), F.col("__r") == F.col("__q"))
    return numbered.withColumn(out, F.col("__skip") + F.row_number().over(Window.partitionBy("__r").orderBy(*order))).drop("__r", "__q", "__skip")


def weighted(parts: dict[str, float]) -> Column:
    """Sum of column * weight with missing columns as 0; the weights must add up to 1."""
    if abs(sum(parts.values()) - 1) > 1e-6:
        raise ValueError("weights must add up to 1")
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + F.coalesce(F.col(c), F.lit(0.0)) * w
    return out
