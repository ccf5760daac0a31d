"""Queries of the composite operators (assembly, scores, rollups, texts, lookups) over the supplied tables, each with SQL
that gives the same rows. Weights, bands and caps are parameters here, not business rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import assemble as A
from ..operators import reshape as R
from ..operators.rollup import live_scores
from ..runtime import checked_broadcast, table
from .reference_queries import _BAND, _F, BANDS, POINTS, Query, _pct, facilities

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# --- assembly ---------------------------------------------------------------------------------------------------

_PLACES = f"""{_F}, d AS (SELECT DISTINCT account_id, facility_id, facility_name, address, city, state, zip, voc, dart, employee_count, has_air_major_permit, facility_vertical,
  split_part(member_source_ids[1], ':', 1) AS source, member_source_ids[1] AS member_id FROM f WHERE facility_id IN (SELECT facility_id FROM facilities GROUP BY 1 HAVING count(*) = 1)),
k AS (SELECT *, upper(trim(coalesce(address, facility_id), ' ')) AS k1, upper(coalesce(city, '')) AS k2 FROM d)"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Facility rows of unique ids as members of clusters by account, address and city."""
    f = facilities(spark, sf)
    one = f.groupBy("facility_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select("facility_id")
    first = F.get("member_source_ids", F.lit(0))
    cols = ("account_id", "facility_id", "facility_name", "address", "city", "state", "zip", "voc", "dart", "employee_count", "has_air_major_permit", "facility_vertical")
    m = f.join(one, "facility_id").select(*cols, F.substring_index(first, ":", 1).alias("source"), first.alias("member_id"))
    return m.withColumns({"k1": F.upper(F.trim(F.coalesce("address", "facility_id"))), "k2": F.upper(F.coalesce("city", F.lit("")))})


@query(
    f"""WITH {_PLACES} SELECT account_id, k1, k2, arg_min(facility_name, facility_id) FILTER (WHERE facility_name IS NOT NULL OR true) AS facility_name, min_by(voc, facility_id) FILTER (WHERE voc IS NOT NULL) AS voc,
  max_by(employee_count, facility_id) FILTER (WHERE employee_count IS NOT NULL) AS employee_count, bool_or(coalesce(has_air_major_permit AND source = 'epa', false)) AS permit, count(*) AS n_members,
  string_agg(member_id, ',' ORDER BY facility_id) AS member_ids, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM k GROUP BY account_id, k1, k2"""
)
def q_place_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """One place for each cluster: first member's name, first present emissions, last present headcount, any permit."""
    a = A.assemble_places(
        _members(spark, sf), ["account_id", "k1", "k2"], "facility_id", ["facility_name"], ["voc"], ["employee_count"], {"permit": F.col("has_air_major_permit") & (F.col("source") == "epa")}
    )
    return a.withColumns({"member_ids": F.array_join("member_ids", ","), "sources": F.array_join("sources", ",")})


_REASON = "CASE WHEN voc > 0 THEN 'emissions on file' WHEN has_air_major_permit THEN 'major permit' WHEN employee_count >= 100 THEN 'headcount' END"


@query(
    f"""WITH {_PLACES}, r AS (SELECT *, {_REASON} AS reason FROM k), c AS (SELECT account_id, k1, k2, min_by(reason, facility_id) FILTER (WHERE reason IS NOT NULL) AS reason, max(facility_vertical) AS vertical FROM r GROUP BY 1, 2, 3)
SELECT account_id, k1, k2, reason, reason IS NOT NULL AND NOT (reason = 'headcount' AND vertical IS NULL) AS qualified FROM c"""
)
def q_qualified_places(spark: SparkSession, sf: str) -> DataFrame:
    """The first member's reason; headcount alone doesn't qualify a place without a vertical."""
    tests = {"emissions on file": F.col("voc") > 0, "major permit": F.col("has_air_major_permit"), "headcount": F.col("employee_count") >= 100}
    c = _members(spark, sf).groupBy("account_id", "k1", "k2").agg(A.first_reason(tests, "facility_id").alias("reason"), F.max("facility_vertical").alias("vertical"))
    qualified = F.col("reason").isNotNull() & ~F.coalesce((F.col("reason") == "headcount") & F.col("vertical").isNull(), F.lit(False))
    return c.select("account_id", "k1", "k2", "reason", qualified.alias("qualified"))


@query(
    """WITH p AS (SELECT account_id, facility_id, facility_name, qualified_for_tcv AS q, installed_status AS s FROM facilities), w AS (SELECT account_id, count(*) AS n FROM facilities WHERE suspect_coordinates GROUP BY 1),
a AS (SELECT account_id, arg_min(facility_name, facility_id || coalesce(facility_name, '')) AS name, count(*) AS places, count(*) FILTER (WHERE q) AS qualified, count(*) FILTER (WHERE q AND s = 'untouched') AS untouched FROM p GROUP BY 1)
SELECT account_id, CASE WHEN account_id = 'NUNINDSTROM KEYSTONE FORGE' THEN 'Keystone Forge' ELSE name END AS name, places, qualified, untouched, coalesce(w.n, 0) AS pending FROM a LEFT JOIN w USING (account_id)"""
)
def q_account_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts with counters; rows with suspect coordinates stand for those pending review."""
    f = table(spark, sf, "facilities").withColumn("by", F.concat("facility_id", F.coalesce("facility_name", F.lit(""))))
    pending = f.filter("suspect_coordinates")
    return A.assemble_accounts(f, pending, "account_id", "facility_name", "by", F.col("qualified_for_tcv"), F.col("installed_status") == "untouched", {"NUNINDSTROM KEYSTONE FORGE": "Keystone Forge"})


PATTERNS = {"keystone": ["NUNINDSTROM"], "crest": ["TROSKENCREST", "CROCKENCREST"], "dolomock": ["DOLOMOCK"]}


@query(
    r"""WITH n AS (SELECT account_key, regexp_replace(upper(trim(recipient_name, ' ')), '^(THE|A|AN)\s+', '') AS u FROM dod_awards WHERE account_key IS NOT NULL AND recipient_name IS NOT NULL),
h AS (SELECT account_key, 'keystone' AS hit FROM n WHERE regexp_matches(u, '^NUNINDSTROM([^A-Z0-9]|$)') UNION SELECT account_key, 'crest' FROM n WHERE regexp_matches(u, '^(TROSKENCREST|CROCKENCREST)([^A-Z0-9]|$)')
UNION SELECT account_key, 'dolomock' FROM n WHERE regexp_matches(u, '^DOLOMOCK([^A-Z0-9]|$)')) SELECT account_key, array_to_string(list_sort(list(hit)), ',') AS hits FROM h GROUP BY 1"""
)
def q_pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dod_awards").filter("account_key is not null and recipient_name is not null")
    return A.pattern_hits(d, "account_key", F.col("recipient_name"), PATTERNS).withColumn("hits", F.array_join("hits", ","))


_CITY_SUMS = """s AS (SELECT account_key AS g, upper(coalesce(pop_city, '')) AS c, upper(coalesce(pop_state, '')) AS s, sum(coalesce(award_amount, 0)) AS t, count(*) AS n FROM dod_awards GROUP BY ALL),
k AS (SELECT account_id AS g, upper(coalesce(city, '')) AS c, upper(coalesce(state, '')) AS s, count(*) > 1 AS shared FROM facilities GROUP BY ALL)"""


@query(
    f"""WITH {_CITY_SUMS} SELECT facility_id, CASE WHEN s.n IS NULL THEN 'no awards in this city' WHEN k.shared THEN s.n || ' awards shared by places in this city' ELSE s.n || ' awards' END AS note
FROM facilities f LEFT JOIN s ON f.account_id = s.g AND upper(coalesce(f.city, '')) = s.c AND upper(coalesce(f.state, '')) = s.s LEFT JOIN k ON f.account_id = k.g AND upper(coalesce(f.city, '')) = k.c AND upper(coalesce(f.state, '')) = k.s
WHERE f.account_id IN (SELECT account_key FROM dod_awards WHERE upper(recipient_name) LIKE 'NUNINDSTROM%' OR upper(recipient_name) LIKE 'DOLOMOCK%')"""
)
def q_anchor_run(spark: SparkSession, sf: str) -> DataFrame:
    """The run for accounts that a pattern names: prefilter by semi join, attribution by city, a note for each place."""
    d = table(spark, sf, "dod_awards")
    name = F.upper("recipient_name")
    wanted = d.filter(name.startswith("NUNINDSTROM") | name.startswith("DOLOMOCK")).select(F.col("account_key").alias("account_id"))
    f = table(spark, sf, "facilities").select("facility_id", "account_id", "city", "state")
    amounts = d.select(F.col("account_key").alias("account_id"), F.col("pop_city").alias("city"), F.col("pop_state").alias("state"), "award_amount")
    got = R.attributed(f, amounts, "account_id", ["city", "state"], "award_amount").join(wanted, "account_id", "left_semi")
    note = F.substring_index(A.attribution_note(F.col("total_amount"), F.col("n_amounts"), F.col("shared")), ",", 1)
    return got.select("facility_id", note.alias("note"))


# --- scores -----------------------------------------------------------------------------------------------------

WEIGHTS = {"voc_pct": 0.22, "voc_trend_score": 0.08, "dart": 0.25, "award_pct": 0.2, "size": 0.15, "permit": 0.1}
TREND = {"up": 100.0, "flat": 50.0, "down": 0.0}
_TREND = "CASE {0} WHEN 'up' THEN 100.0 WHEN 'flat' THEN 50.0 WHEN 'down' THEN 0.0 ELSE 50.0 END"
_FULL = f"""{_F}, g AS (SELECT *, CASE WHEN dod_awards_here_ttm > 0 THEN ln(1 + dod_awards_here_ttm) END AS aw, 'all' AS one FROM f),
s AS (SELECT *, {_pct('voc', 'facility_vertical')} AS voc_pct, {_pct('dart', 'facility_vertical')} AS dart_pct, {_pct('aw', 'one')} AS award_pct, {_BAND} AS size, {_TREND.format('voc_trend')} AS voc_trend_score,
  {_TREND.format('dart_trend')} AS dart_trend_score, CASE WHEN has_air_major_permit THEN 100.0 ELSE 0.0 END AS permit FROM g),
full_score AS (SELECT *, coalesce(voc_pct, 0) * 0.22 + voc_trend_score * 0.08 + (coalesce(dart_pct, 0) * 0.7 + dart_trend_score * 0.3) * 0.25 + coalesce(award_pct, 0) * 0.2 + size * 0.15 + permit * 0.1 AS score FROM s)"""


def looked_up(value: Column, scores: dict[str, float], default: float) -> Column:
    """The score of a value, or the default for others and null."""
    known = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
    return F.coalesce(known[value], F.lit(default))


def full_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All six components of a place and their weighted sum."""
    f = facilities(spark, sf).withColumn("aw", F.when(F.col("dod_awards_here_ttm") > 0, F.log(F.lit(1.0) + F.col("dod_awards_here_ttm"))))
    f = S.group_percentiles(f, [("voc", "facility_vertical", "voc_pct"), ("dart", "facility_vertical", "dart_pct"), ("aw", None, "award_pct")])
    f = f.withColumns({"size": S.band_score(F.col("employee_count"), BANDS), "voc_trend_score": looked_up(F.col("voc_trend"), TREND, 50.0), "dart_trend_score": looked_up(F.col("dart_trend"), TREND, 50.0), "permit": F.when(F.col("has_air_major_permit"), 100.0).otherwise(0.0)})
    f = f.withColumn("dart_mix", F.coalesce("dart_pct", F.lit(0.0)) * 0.7 + F.col("dart_trend_score") * 0.3)
    return f.withColumn("score", S.weighted({("dart_mix" if k == "dart" else k): v for k, v in WEIGHTS.items()}))


@query(f"WITH {_FULL} SELECT facility_id, round(voc_pct, 4) AS voc_pct, voc_trend_score, round(dart_pct, 4) AS dart_pct, round(award_pct, 3) AS award_pct, size, permit, round(score, 3) AS score FROM full_score")
def q_full_score(spark: SparkSession, sf: str) -> DataFrame:
    f = full_scores(spark, sf)
    return f.select("facility_id", F.round("voc_pct", 4).alias("voc_pct"), "voc_trend_score", F.round("dart_pct", 4).alias("dart_pct"), F.round("award_pct", 3).alias("award_pct"), "size", "permit", F.round("score", 3).alias("score"))


@query(f"WITH {_F} SELECT facility_id, voc_trend, {_TREND.format('voc_trend')} AS score FROM f")
def q_trend_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return facilities(spark, sf).select("facility_id", "voc_trend", looked_up(F.col("voc_trend"), TREND, 50.0).alias("score"))


RATIOS = {"airframe": 0.2, "heavy_vehicle": 0.25}
_RATIO = "CASE facility_vertical WHEN 'airframe' THEN 0.2 WHEN 'heavy_vehicle' THEN 0.25 ELSE 0.1 END"
_CAP = """CAST(floor(CASE WHEN m3 <= 0 THEN 12 WHEN m3 <= 20 THEN 12 + m3 * (4.0 / 20) WHEN m3 <= 45 THEN 16 + (m3 - 20) * (8.0 / 25)
  WHEN m3 <= 70 THEN 24 + (m3 - 45) * (4.0 / 25) WHEN m3 <= 100 THEN 28 + (m3 - 70) * (4.0 / 30) ELSE 32 END) AS BIGINT)"""
_CELLS = f"""{_FULL}, m AS (SELECT *, round((size + coalesce(voc_pct, 0) + permit) / 3, 3) AS m3, CASE WHEN employee_count <= 41250 THEN employee_count END AS heads FROM full_score),
cells AS (SELECT *, {_CAP} AS cap, CASE WHEN heads IS NOT NULL THEN least(CAST(floor(heads * {_RATIO} / 4) AS BIGINT), {_CAP}) END AS cells FROM m)"""


def with_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Units from the capped headcount and the share of its vertical, limited by the magnitude of the place's signals."""
    f = full_scores(spark, sf)
    mean = F.round((F.col("size") + F.coalesce("voc_pct", F.lit(0.0)) + F.col("permit")) / 3, 3)
    f = f.withColumns({"m3": mean, "heads": S.capped(F.col("employee_count"), 41_250)}).withColumn("cap", S.interpolated(F.col("m3"), POINTS))
    return f.withColumn("cells", A.capacity(F.col("heads"), looked_up(F.col("facility_vertical"), RATIOS, 0.1), 4, F.col("cap")))


@query(f"WITH {_CELLS} SELECT facility_id, heads, cap, cells FROM cells")
def q_capacity_from_headcount(spark: SparkSession, sf: str) -> DataFrame:
    return with_cells(spark, sf).select("facility_id", "heads", "cap", "cells")


_RUNGS = f"""{_CELLS}, o AS (SELECT facility_vertical AS v, cells AS c, row_number() OVER (PARTITION BY facility_vertical ORDER BY cells) AS k, count(*) OVER (PARTITION BY facility_vertical) AS n FROM cells
  WHERE cells > 0 AND facility_vertical IS NOT NULL), md AS (SELECT v, c AS median_cells FROM o WHERE k = floor(n / 2) + 1 AND n >= 3),
chain AS (SELECT *, CASE WHEN NOT coalesce(qualified_for_tcv, false) THEN 0 WHEN coalesce(cells, 0) <> 0 THEN cells WHEN coalesce(voc, 0) <> 0 THEN least(CAST(floor(voc * 0.5) AS BIGINT), cap)
    WHEN coalesce(pm10_tons_2020, 0) <> 0 AND NOT isnan(pm10_tons_2020) THEN least(CAST(floor(pm10_tons_2020 * 2) AS BIGINT), cap) WHEN median_cells IS NOT NULL THEN median_cells ELSE 0 END AS estimate,
  CASE WHEN NOT coalesce(qualified_for_tcv, false) THEN 'not_qualified' WHEN coalesce(cells, 0) <> 0 THEN 'actual' WHEN coalesce(voc, 0) <> 0 THEN 'voc_estimated'
    WHEN coalesce(pm10_tons_2020, 0) <> 0 AND NOT isnan(pm10_tons_2020) THEN 'pm10_estimated' WHEN median_cells IS NOT NULL THEN 'vertical_median' ELSE 'no_estimate' END AS basis FROM cells LEFT JOIN md ON facility_vertical = v)"""


def chained(spark: SparkSession, sf: str) -> DataFrame:
    """Own units, else from emissions, else from dust, else the upper median of the vertical (of three places or more),
    else none; places that aren't qualified have 0 and say so."""
    f = with_cells(spark, sf)
    usual = S.upper_median(f.filter("cells > 0"), "facility_vertical", "cells").select(F.col("facility_vertical").alias("v"), F.col("upper_median").alias("median_cells"))
    f = f.join(checked_broadcast(usual), F.col("facility_vertical") == F.col("v"), "left")
    pm = F.when(~F.isnan("pm10_tons_2020"), F.col("pm10_tons_2020"))
    usable = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    steps = [
        ("not_qualified", ~F.coalesce("qualified_for_tcv", F.lit(False)), F.lit(0).cast("long")),
        ("actual", usable(F.col("cells")), F.col("cells")),
        ("voc_estimated", usable(F.col("voc")), F.least(F.floor(F.col("voc") * 0.5), F.col("cap"))),
        ("pm10_estimated", usable(pm), F.least(F.floor(pm * 2), F.col("cap"))),
        ("vertical_median", F.col("median_cells").isNotNull(), F.col("median_cells")),
    ]
    estimate, basis = F.lit(0).cast("long"), F.lit("no_estimate")
    for name, when, value in reversed(steps):
        estimate, basis = F.when(when, value).otherwise(estimate), F.when(when, name).otherwise(basis)
    return f.withColumns({"estimate": estimate, "basis": basis})


@query(f"WITH {_RUNGS} SELECT facility_id, estimate, basis, basis NOT IN ('actual', 'not_qualified') AS derived FROM chain")
def q_estimate_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chained(spark, sf).select("facility_id", "estimate", "basis", (~F.col("basis").isin("actual", "not_qualified")).alias("derived"))


@query(f"WITH {_RUNGS}, a AS (SELECT account_id, sum(estimate) AS e FROM chain WHERE qualified_for_tcv AND installed_status = 'untouched' GROUP BY 1) SELECT DISTINCT f.account_id, CAST(coalesce(e, 0) AS BIGINT) AS ceiling FROM facilities f LEFT JOIN a USING (account_id)")
def q_account_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over qualified and untouched places, joined back to all accounts with 0 for none."""
    c = chained(spark, sf)
    return c.groupBy("account_id").agg(F.coalesce(F.sum(F.when(F.col("qualified_for_tcv") & (F.col("installed_status") == "untouched"), F.col("estimate"))), F.lit(0)).alias("ceiling"))


_WHY = f"""{_RUNGS}, sm AS (SELECT facility_vertical AS sv, median(dart) AS m FROM f WHERE dart IS NOT NULL AND facility_vertical IS NOT NULL GROUP BY 1), w AS (SELECT facility_id,
  CASE WHEN has_air_major_permit THEN 'major air permit' END AS c1,
  CASE WHEN voc_pct IS NOT NULL THEN p || CASE WHEN p % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p % 10 = 1 THEN 'st' WHEN p % 10 = 2 THEN 'nd' WHEN p % 10 = 3 THEN 'rd' ELSE 'th' END || ' percentile of emissions in ' || facility_vertical END AS c2,
  CASE WHEN dart IS NOT NULL AND m > 0 THEN trim('injury rate ' || CAST(CAST(floor(dart / m * 10 + 0.5) / 10 AS DECIMAL(18, 1)) AS VARCHAR) || ' times the median ' || CASE dart_trend WHEN 'up' THEN 'and rising' WHEN 'down' THEN 'and falling' WHEN 'flat' THEN 'and flat' ELSE '' END)
    WHEN dart IS NOT NULL THEN 'injury rate ' || CAST(CAST(floor(dart * 10 + 0.5) / 10 AS DECIMAL(18, 1)) AS VARCHAR) END AS c3,
  CASE WHEN estimate > 0 THEN 'about ' || estimate || ' units' || CASE WHEN basis NOT IN ('actual', 'not_qualified') THEN ' (estimated)' ELSE '' END END AS c4
FROM (SELECT *, CAST(floor(voc_pct + 0.5) AS INT) AS p FROM chain) LEFT JOIN sm ON facility_vertical = sv)"""


@query(f"WITH {_WHY} SELECT facility_id, CASE WHEN concat_ws('. ', c1, c2, c3, c4) = '' THEN 'No signal on file.' ELSE concat_ws('. ', c1, c2, c3, c4) || '.' END AS why FROM w")
def q_rationale(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks for a place, with its figures, as sentences."""
    c = chained(spark, sf)
    m = S.exact_median(facilities(spark, sf), "facility_vertical", "dart").select(F.col("facility_vertical").alias("sv"), F.col("median").alias("m"))
    c = c.join(checked_broadcast(m), F.col("facility_vertical") == F.col("sv"), "left")
    one = lambda x: S.half_up(x, 1).cast("decimal(18,1)").cast("string")
    word = F.create_map(*(F.lit(x) for x in ("up", "and rising", "down", "and falling", "flat", "and flat")))[F.col("dart_trend")]
    rate = F.when(F.col("dart").isNotNull() & (F.col("m") > 0), F.trim(F.concat(F.lit("injury rate "), one(F.col("dart") / F.col("m")), F.lit(" times the median "), F.coalesce(word, F.lit("")))))
    rate = rate.when(F.col("dart").isNotNull(), F.concat(F.lit("injury rate "), one(F.col("dart"))))
    derived = F.when(~F.col("basis").isin("actual", "not_qualified"), " (estimated)").otherwise("")
    why = T.sentences(
        F.when(F.col("has_air_major_permit"), "major air permit"),
        F.concat(T.ordinal(F.floor(F.col("voc_pct") + 0.5).cast("int")), F.lit(" percentile of emissions in "), "facility_vertical"),
        rate,
        F.when(F.col("estimate") > 0, F.concat(F.lit("about "), F.col("estimate").cast("string"), F.lit(" units"), derived)),
        default="No signal on file.",
    )
    return c.select("facility_id", why.alias("why"))


LIVE = {"voc_pct": 22.0, "voc_trend_score": 8.0, "dart_mix": 25.0, "award_pct": 20.0, "size_mix": 25.0}
_LIVE = f"""{_RUNGS}, live AS (SELECT *, floor((coalesce(voc_pct, 0) * 0.22 + voc_trend_score * 0.08 + (coalesce(dart_pct, 0) * 0.7 + dart_trend_score * 0.3) * 0.25 + coalesce(award_pct, 0) * 0.2 + (size * 0.6 + permit * 0.4) * 0.25) * 10 + 0.5) / 10 AS live,
  CAST((voc_pct IS NOT NULL) AS INT) + CAST((voc_trend <> 'no_data') AS INT) + CAST((dart_pct IS NOT NULL) AS INT) + CAST((award_pct IS NOT NULL) AS INT) + CAST((employee_count IS NOT NULL) AS INT) AS signals FROM chain),
ok AS (SELECT *, coalesce(qualified_for_tcv AND live >= 35, false) AS ok FROM live)"""


def rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Five signals under other weights, how many of them are present, and whether the place passes."""
    c = chained(spark, sf).withColumn("size_mix", F.col("size") * 0.6 + F.col("permit") * 0.4)
    present = [F.col("voc_pct").isNotNull(), F.col("voc_trend") != "no_data", F.col("dart_pct").isNotNull(), F.col("award_pct").isNotNull(), F.col("employee_count").isNotNull()]
    signals = sum((p.cast("int") for p in present[1:]), present[0].cast("int"))
    c = live_scores(c, LIVE, "live").withColumn("signals", signals)
    return c.withColumn("ok", F.coalesce(F.col("qualified_for_tcv") & (F.col("live") >= 35), F.lit(False)))


@query(f"WITH {_LIVE} SELECT facility_id, live, signals, ok FROM ok")
def q_live_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rescored(spark, sf).select("facility_id", "live", "signals", "ok")


@query(
    f"""WITH {_LIVE} SELECT account_id, count(*) AS places, count(*) FILTER (WHERE ok) AS qualified, CAST(sum(CASE WHEN ok THEN estimate ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN ok AND installed_status = 'untouched' THEN estimate ELSE 0 END) AS BIGINT) AS untouched,
  CAST(sum(CASE WHEN ok AND installed_status = 'installed' THEN estimate ELSE 0 END) AS BIGINT) AS installed FROM ok GROUP BY 1"""
)
def q_status_sums(spark: SparkSession, sf: str) -> DataFrame:
    status = lambda s: F.sum(F.when(F.col("ok") & (F.col("installed_status") == s), F.col("estimate")).otherwise(0))
    return rescored(spark, sf).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("places"), F.count_if("ok").alias("qualified"), F.sum(F.when(F.col("ok"), F.col("estimate")).otherwise(0)).alias("total"), status("untouched").alias("untouched"), status("installed").alias("installed")
    )


PUBLIC = ["u.s. navy", "u.s. air force", "u.s. army", "u.s. marine corps", "u.s. coast guard", "u.s. space force"]
_PUBLIC = ", ".join(f"'{x}'" for x in PUBLIC)
_ACCOUNTS = f"""{_LIVE}, acc AS (SELECT account_id, CAST(sum(CASE WHEN ok AND installed_status = 'untouched' THEN estimate ELSE 0 END) AS BIGINT) AS untouched, count(*) FILTER (WHERE ok) AS qualified, bool_or(coalesce(installed_status = 'installed', false)) AS customer FROM ok GROUP BY 1)"""


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    return rescored(spark, sf).groupBy("account_id").agg(
        F.sum(F.when(F.col("ok") & (F.col("installed_status") == "untouched"), F.col("estimate")).otherwise(0)).alias("untouched"), F.count_if("ok").alias("qualified"), F.bool_or(F.coalesce(F.col("installed_status") == "installed", F.lit(False))).alias("customer")
    )


@query(
    f"""WITH {_ACCOUNTS} SELECT count(*) AS accounts, count(*) FILTER (WHERE untouched >= 20 AND lower(trim(account_id)) NOT IN ({_PUBLIC})) AS great, CAST(sum(CASE WHEN untouched >= 20 AND lower(trim(account_id)) NOT IN ({_PUBLIC}) THEN untouched ELSE 0 END) AS BIGINT) AS great_sum,
  CAST(sum(qualified) AS BIGINT) AS qualified, CAST(sum(untouched) AS BIGINT) AS total, CAST(coalesce(sum(untouched) FILTER (WHERE customer), 0) AS BIGINT) AS customers FROM acc"""
)
def q_headline_tiers(spark: SparkSession, sf: str) -> DataFrame:
    great = (F.col("untouched") >= 20) & (T.badge(F.col("account_id"), PUBLIC, F.lit(False)) != "government")
    return _accounts(spark, sf).agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(great).alias("great"), F.sum(F.when(great, F.col("untouched")).otherwise(0)).alias("great_sum"), F.sum("qualified").alias("qualified"), F.sum("untouched").alias("total"),
        F.coalesce(F.sum(F.when(F.col("customer"), F.col("untouched"))), F.lit(0)).alias("customers"),
    )


@query(f"WITH {_ACCOUNTS} SELECT account_id, untouched, qualified, customer FROM acc WHERE qualified > 0 OR customer")
def q_exported_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return _accounts(spark, sf).filter((F.col("qualified") > 0) | F.col("customer")).select("account_id", "untouched", "qualified", "customer")


@query(
    """SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) = 'government' OR lower(trim(c_mktsegment)) = 'machinery' THEN 'government' WHEN c_acctbal > 0 THEN 'customer' ELSE 'prospect' END AS badge,
  CASE WHEN c_acctbal >= 1e3 THEN '$' || CAST(CAST(floor(c_acctbal / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE '$' || CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) END AS money FROM customer WHERE c_acctbal > 1"""
)
def q_badge_money(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_acctbal > 1")
    return c.select("c_custkey", T.badge(F.col("c_mktsegment"), ["government", "machinery"], F.col("c_acctbal") > 0).alias("badge"), T.money(F.col("c_acctbal").cast("double")).alias("money"))


# --- rows, order, lookups ---------------------------------------------------------------------------------------


@query(
    r"""WITH l AS (SELECT upper(trim(address)) AS a, upper(trim(city)) AS c, state AS s, min(latitude) AS lat, min(longitude) AS lon FROM frs_facilities_raw WHERE address IS NOT NULL AND city IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY 1, 2, 3),
f AS (SELECT establishment_id, year, upper(trim(street_address)) AS a, upper(trim(city)) AS c, state AS s, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon FROM osha_establishments)
SELECT establishment_id, year, l.lat, l.lon, l.lat IS NOT NULL AS filled FROM f LEFT JOIN l USING (a, c, s)"""
)
def q_points_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a point get that of a lookup by address, if it has one; others keep theirs."""
    e = table(spark, sf, "frs_facilities_raw").filter("address is not null and city is not null and latitude between -90 and 90 and longitude between -180 and 180")
    lookup = e.groupBy(F.upper(F.trim("address")).alias("a"), F.upper(F.trim("city")).alias("c"), F.col("state").alias("s")).agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    none = F.lit(None).cast("double")
    o = table(spark, sf, "osha_establishments").select("establishment_id", "year", F.upper(F.trim("street_address")).alias("a"), F.upper(F.trim("city")).alias("c"), F.col("state").alias("s"), none.alias("lat"), none.alias("lon"))
    return A.filled(o, lookup, ["a", "c", "s"], ["lat", "lon"], F.col("lat").isNull()).select("establishment_id", "year", "lat", "lon", "filled")


@query("SELECT establishment_id, CAST(CAST(year AS VARCHAR) AS BIGINT) AS year FROM osha_establishments WHERE CAST(CAST(year AS VARCHAR) AS BIGINT) = 2024")
def q_strict_year(spark: SparkSession, sf: str) -> DataFrame:
    """The year as text, cast strictly: a text that is no number raises."""
    year = S.strict_long(F.col("year").cast("string"))
    return table(spark, sf, "osha_establishments").select("establishment_id", year.alias("year")).filter("year = 2024")


@query("SELECT facility_id, facility_name, city, state FROM facilities WHERE account_id = 'NUNINDSTROM KEYSTONE FORGE' AND installed_status = 'untouched'")
def q_account_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The places of one account with one status: both reach the scan."""
    f = table(spark, sf, "facilities").filter((F.col("account_id") == "NUNINDSTROM KEYSTONE FORGE") & (F.col("installed_status") == "untouched"))
    return f.select("facility_id", "facility_name", "city", "state")


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name END AS partner, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal END AS balance, CASE WHEN s_suppkey IS NULL THEN 'no match on file' ELSE 'matched' END AS note FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def q_enriched_columns(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    matched = F.col("s_suppkey").isNotNull()
    note = F.when(matched, "matched").otherwise("no match on file")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left").select("c_custkey", F.when(matched, F.col("s_name")).alias("partner"), F.when(matched, F.col("s_acctbal")).alias("balance"), note.alias("note"))


@query("WITH f AS (SELECT facility_id, min(city) AS city FROM facilities WHERE facility_id IS NOT NULL GROUP BY 1) SELECT facility_id, row_number() OVER (ORDER BY upper(coalesce(city, '')), facility_id) AS pos FROM f")
def q_city_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each facility in the order of cities, numbered over all rows without bringing them into one task."""
    f = table(spark, sf, "facilities").filter("facility_id is not null").groupBy("facility_id").agg(F.min("city").alias("city"))
    return S.positions(f, [F.upper(F.coalesce("city", F.lit(""))), F.col("facility_id")], "pos").select("facility_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT establishment_id, year, row_number() OVER (PARTITION BY establishment_id ORDER BY year, dart_rate NULLS FIRST, establishment_name NULLS FIRST, street_address NULLS FIRST) AS k FROM (SELECT DISTINCT establishment_id, year, dart_rate, establishment_name, street_address FROM osha_establishments WHERE establishment_id IS NOT NULL)")
def q_filing_order(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("year", "dart_rate", "establishment_name", "street_address")
    o = table(spark, sf, "osha_establishments").filter("establishment_id is not null").select("establishment_id", *cols).distinct()
    return o.select("establishment_id", "year", F.row_number().over(Window.partitionBy("establishment_id").orderBy(*cols)).alias("k"))


@query(f"WITH {_LIVE} SELECT facility_id, live, k FROM (SELECT facility_id, live, row_number() OVER (ORDER BY live DESC, facility_id) AS k FROM (SELECT facility_id, max(live) AS live FROM ok WHERE facility_id IS NOT NULL GROUP BY 1))")
def q_live_order(spark: SparkSession, sf: str) -> DataFrame:
    c = rescored(spark, sf).filter("facility_id is not null").groupBy("facility_id").agg(F.max("live").alias("live"))
    return S.positions(c, [F.desc("live"), F.col("facility_id")], "k").select("facility_id", "live", F.col("k").cast("long").alias("k"))


@query("SELECT naics_code FROM osha_establishments WHERE naics_code IS NOT NULL UNION SELECT unnest(matched_naics_codes) FROM frs_facilities_raw UNION SELECT naics_code FROM dod_awards WHERE naics_code IS NOT NULL")
def q_code_union(spark: SparkSession, sf: str) -> DataFrame:
    codes = [table(spark, sf, t).filter("naics_code is not null").select("naics_code") for t in ("osha_establishments", "dod_awards")]
    return codes[0].union(codes[1]).union(table(spark, sf, "frs_facilities_raw").select(F.explode("matched_naics_codes").alias("naics_code"))).distinct()


@query("SELECT DISTINCT account_id, sources[1] AS source, bool_or(coalesce(has_air_major_permit, false) AND list_contains(sources, 'epa')) OVER (PARTITION BY account_id, sources[1]) AS permit FROM facilities")
def q_any_permit(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.coalesce(F.col("has_air_major_permit"), F.lit(False)) & F.array_contains("sources", "epa")
    return table(spark, sf, "facilities").groupBy("account_id", F.get("sources", F.lit(0)).alias("source")).agg(F.bool_or(ok).alias("permit"))


_REGIONS = "CASE " + " ".join(f"WHEN state IN ({', '.join(repr(s) for s in states.split())}) THEN '{region}'" for region, states in T.REGIONS.items()) + " END"


@query(f"SELECT region, count(*) AS places, count(DISTINCT account_id) AS accounts FROM (SELECT {_REGIONS} AS region, account_id FROM facilities) WHERE region IS NOT NULL GROUP BY 1")
def q_region_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Places by region; a state of no region is left out."""
    f = table(spark, sf, "facilities").withColumn("region", T.region_of(F.col("state"))).filter("region is not null")
    per = f.groupBy("region", "account_id").agg(F.count(F.lit(1)).alias("n"))  # one row an account before counting them
    return per.groupBy("region").agg(F.sum("n").alias("places"), F.count("account_id").alias("accounts"))


@query(
    f"""WITH {_F}, v AS (SELECT coalesce(state, '??') AS state, lat, lon, installed_status FROM f WHERE NOT suspect_coordinates AND lat IS NOT NULL AND lon IS NOT NULL)
SELECT state, count(*) AS n, round(greatest(1, least(99, (avg(lon) + 126) / 60 * 100)), 4) AS x, round(greatest(1, least(99, (50.5 - avg(lat)) / 26 * 100)), 4) AS y, CAST(floor(16 + sqrt(count(*)) * 2.4 + 0.5) AS BIGINT) AS size,
  round(count(*) FILTER (WHERE installed_status = 'untouched') / count(*), 6) AS untouched_share FROM v GROUP BY 1"""
)
def q_map_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Points of a state map: clamped projection of the mean point, size by the root, share of untouched places."""
    v = facilities(spark, sf).filter("not suspect_coordinates and lat is not null and lon is not null")
    g = v.groupBy(F.coalesce("state", F.lit("??")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count_if(F.col("installed_status") == "untouched").alias("u"))
    clamp = lambda c: F.round(F.greatest(F.lit(1.0), F.least(F.lit(99.0), c)), 4)
    return g.select(
        "state", "n", clamp((F.col("lon") + 126) / 60 * 100).alias("x"), clamp((F.lit(50.5) - F.col("lat")) / 26 * 100).alias("y"), F.floor(F.lit(16.5) + F.sqrt("n") * 2.4).alias("size"), F.round(F.col("u") / F.col("n"), 6).alias("untouched_share")
    )


@query("SELECT facility_id, round_even(employee_count / 4, 1) AS quarter FROM facilities WHERE employee_count IS NOT NULL")
def q_half_even(spark: SparkSession, sf: str) -> DataFrame:
    """Halves to the even digit."""
    return table(spark, sf, "facilities").filter("employee_count is not null").select("facility_id", F.bround(F.col("employee_count") / 4, 1).alias("quarter"))


@query("SELECT account_id, array_to_string(list_sort(list(DISTINCT match_reason)), '; ') AS reasons FROM facilities WHERE match_reason IS NOT NULL GROUP BY 1")
def q_reason_list(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "facilities").filter("match_reason is not null")
    return R.distinct_lists(f, "account_id", "match_reason", "reasons").withColumn("reasons", F.array_join("reasons", "; "))


_SHOWN = "CASE WHEN length(trim(company_name, ' ')) >= 12 THEN trim(company_name, ' ') WHEN industry_description IS NOT NULL THEN 'Unresolved account — ' || industry_description ELSE 'Unresolved account' END"


@query(f"SELECT DISTINCT company_name, industry_description, {_SHOWN} AS shown FROM osha_establishments WHERE company_name IS NULL OR length(trim(company_name, ' ')) < 3 OR regexp_full_match(trim(company_name, ' '), '[A-Z]+ [A-Z]+ [A-Z]+')")
def q_account_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    """The name of an account or, if it isn't fit to be shown, a placeholder with its trade."""
    name = F.trim("company_name")
    o = table(spark, sf, "osha_establishments").filter(F.col("company_name").isNull() | (F.length(name) < 3) | name.rlike(r"^[A-Z]+ [A-Z]+ [A-Z]+$"))
    shown = F.when(T.displayable(F.col("company_name")), name).when(F.col("industry_description").isNotNull(), F.concat(F.lit("Unresolved account — "), "industry_description")).otherwise("Unresolved account")
    return o.select("company_name", "industry_description", shown.alias("shown")).distinct()


@query(
    f"""WITH {_F} SELECT facility_id, voc IS NOT NULL AS voc_present, coalesce(CAST(CAST(floor(voc * 10 + 0.5) / 10 AS DECIMAL(18, 1)) AS VARCHAR) || ' tons', 'none on file') AS voc_raw, CASE WHEN voc IS NOT NULL THEN 'emissions inventory' END AS voc_source,
  dart IS NOT NULL AS dart_present, coalesce(CAST(CAST(floor(dart * 100 + 0.5) / 100 AS DECIMAL(18, 2)) AS VARCHAR), 'none on file') AS dart_raw, employee_count IS NOT NULL AS size_present, coalesce(CAST(CAST(floor(employee_count + 0.5) AS BIGINT) AS VARCHAR) || ' employees', 'none on file') AS size_raw,
  has_air_major_permit AS permit_present, voc_trend <> 'no_data' AS trend_present FROM f"""
)
def q_signal_details(spark: SparkSession, sf: str) -> DataFrame:
    """Five signals as nested records, each with presence, text and source; flattened for the comparison."""
    text = lambda c, d: S.half_up(c, d).cast(f"decimal(18,{d})").cast("string")
    none = F.lit("none on file")
    signal = lambda present, raw, source: F.struct(present.alias("present"), F.coalesce(raw, none).alias("raw"), F.when(present, source).alias("source"))
    voc, dart, n = F.col("voc"), F.col("dart"), F.col("employee_count")
    f = facilities(spark, sf).select(
        "facility_id",
        F.struct(
            signal(voc.isNotNull(), F.concat(text(voc, 1), F.lit(" tons")), "emissions inventory").alias("voc"),
            signal(dart.isNotNull(), text(dart, 2), "injury summaries").alias("dart"),
            signal(n.isNotNull(), F.concat(F.floor(n + 0.5).cast("string"), F.lit(" employees")), "injury summaries").alias("size"),
            signal(F.col("has_air_major_permit"), F.lit("yes"), "register").alias("permit"),
            signal(F.col("voc_trend") != "no_data", F.col("voc_trend"), "emissions inventory").alias("trend"),
        ).alias("s"),
    )
    return f.select("facility_id", F.col("s.voc.present").alias("voc_present"), F.col("s.voc.raw").alias("voc_raw"), F.col("s.voc.source").alias("voc_source"), F.col("s.dart.present").alias("dart_present"), F.col("s.dart.raw").alias("dart_raw"), F.col("s.size.present").alias("size_present"), F.col("s.size.raw").alias("size_raw"), F.col("s.permit.present").alias("permit_present"), F.col("s.trend.present").alias("trend_present"))


@query(
    """WITH g AS (SELECT user_id, event_id, coalesce(value, 1) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id, event_id, n, dense_rank() OVER (ORDER BY n DESC, user_id) AS group_pos, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) AS pos FROM g"""
)
def q_review_order(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a queue by size, the items of each by value; the groups, not their items, are numbered globally."""
    e = table(spark, sf, "events").filter("event_type = 'error'").withColumn("v", F.coalesce("value", F.lit(1.0)))
    sizes = S.positions(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("user_id")], "group_pos")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("v", "event_id"))
    return e.withColumn("pos", pos).join(sizes, "user_id").select("user_id", "event_id", "n", F.col("group_pos").cast("long").alias("group_pos"), "pos")


@query("SELECT d.award_id, d.account_key, a.places, a.name FROM dod_awards d JOIN (SELECT account_id, count(*) AS places, min(facility_name) AS name FROM facilities GROUP BY 1) a ON d.account_key = a.account_id WHERE d.award_amount IS NULL")
def q_pending_with_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to be reviewed with their account; awards without an amount stand for them."""
    a = table(spark, sf, "facilities").groupBy(F.col("account_id").alias("account_key")).agg(F.count(F.lit(1)).alias("places"), F.min("facility_name").alias("name"))
    return table(spark, sf, "dod_awards").filter("award_amount is null").join(a, "account_key").select("award_id", "account_key", "places", "name")


@query("WITH d AS (SELECT registry_id, max(federal_depot_account) AS account, max(federal_depot_category) AS category FROM frs_facilities_raw WHERE federal_depot_account IS NOT NULL GROUP BY 1) SELECT e.registry_id, d.account, d.category FROM frs_facilities_raw e LEFT JOIN d ON e.registry_id = d.registry_id")
def q_payload_join(spark: SparkSession, sf: str) -> DataFrame:
    """A struct payload joined to all rows, made distinct by key first so that no row is doubled."""
    e = table(spark, sf, "frs_facilities_raw")
    d = e.filter("federal_depot_account is not null").groupBy(F.col("registry_id").alias("k")).agg(F.struct(F.max("federal_depot_account").alias("account"), F.max("federal_depot_category").alias("category")).alias("depot"))
    return e.join(d, F.col("registry_id") == F.col("k"), "left").select("registry_id", "depot.account", "depot.category")


@query("SELECT registry_id, list_contains(matched_naics_codes, '336413') AS air, has_air_major_permit AND len(matched_naics_codes) > 0 AS major FROM frs_facilities_raw")
def q_two_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Two predicates over one scan, as columns instead of two reads."""
    return table(spark, sf, "frs_facilities_raw").select("registry_id", F.array_contains("matched_naics_codes", "336413").alias("air"), (F.col("has_air_major_permit") & (F.size("matched_naics_codes") > 0)).alias("major"))


_AK = r"regexp_replace(regexp_replace(regexp_replace(upper(address), '(\b(SUITE|STE|UNIT|APT|BLDG|BUILDING|ROOM|RM|FLOOR|FL|DOCK|LOT)\b\.?\s*#?\s*[A-Z0-9-]+|#\s*[A-Z0-9-]+)', ' ', 'g'), '[^A-Z0-9 -]', ' ', 'g'), '\s+', ' ', 'g')"
_SHORT = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STREET_WORDS.items()) + " ELSE w END"


@query(
    rf"""WITH t AS (SELECT DISTINCT address, city, state, zip, trim({_AK}, ' ') AS t FROM frs_facilities_raw), p AS (SELECT *, regexp_extract(t, '^(\d+[A-Z]?)\s+(\S.*)$', 1) AS n, regexp_extract(t, '^(\d+[A-Z]?)\s+(\S.*)$', 2) AS s FROM t)
SELECT address, city, state, zip, CASE WHEN n <> '' THEN n || ' ' || array_to_string([{_SHORT} FOR w IN string_split(s, ' ')], ' ') || ', ' || concat_ws(' ', nullif(upper(trim(city, ' ')), ''), nullif(upper(trim(state, ' ')), ''), nullif(left(trim(zip, ' '), 5), '')) END AS key FROM p"""
)
def q_address_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "frs_facilities_raw").select("address", "city", "state", "zip").distinct()
    return e.withColumn("key", T.address_key(F.col("address"), F.col("city"), F.col("state"), F.col("zip")))
