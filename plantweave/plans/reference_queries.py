"""Queries of the batch operators over the supplied tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import reshape as R
from ..operators import resolve as V
from ..operators import rollup as U
from ..runtime import checked_broadcast, table
from ..streaming.trends import windowed_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    """Facility rows with NaN as null."""
    f = table(spark, sf, "facilities")
    return f.withColumns({"voc": S.present(F.col("voc_tons_2020")), "dart": S.present(F.col("dart_rate")), "lat": S.present(F.col("latitude")), "lon": S.present(F.col("longitude"))})


_F = """f AS (SELECT *, CASE WHEN NOT isnan(voc_tons_2020) THEN voc_tons_2020 END AS voc, CASE WHEN NOT isnan(dart_rate) THEN dart_rate END AS dart,
  CASE WHEN NOT isnan(latitude) THEN latitude END AS lat, CASE WHEN NOT isnan(longitude) THEN longitude END AS lon FROM facilities)"""


def _pct(value: str, group: str) -> str:
    return (
        f"CASE WHEN {value} IS NOT NULL AND {group} IS NOT NULL THEN (rank() OVER (PARTITION BY {group} ORDER BY {value} NULLS LAST) - 1 "
        f"+ (count({value}) OVER (PARTITION BY {group}, {value}) - 1) / 2.0) / greatest(count({value}) OVER (PARTITION BY {group}) - 1, 1) * 100 END"
    )


# --- scores and ranks -------------------------------------------------------------------------------------------

WEIGHTS = {"voc_pct": 0.4, "dart_pct": 0.35, "size": 0.25}
BANDS = [(9, 10.0), (19, 25.0), (49, 45.0), (149, 65.0), (499, 85.0), (None, 100.0)]
_BAND = "CASE WHEN employee_count IS NULL THEN 0.0 WHEN employee_count <= 9 THEN 10.0 WHEN employee_count <= 19 THEN 25.0 WHEN employee_count <= 49 THEN 45.0 WHEN employee_count <= 149 THEN 65.0 WHEN employee_count <= 499 THEN 85.0 ELSE 100.0 END"
_SCORED = f"""{_F}, s AS (SELECT *, {_pct('voc', 'facility_vertical')} AS voc_pct, {_pct('dart', 'facility_vertical')} AS dart_pct, {_BAND} AS size FROM f),
scored AS (SELECT *, coalesce(voc_pct, 0) * 0.4 + coalesce(dart_pct, 0) * 0.35 + size * 0.25 AS score FROM s)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf)
    f = S.group_percentiles(f, [("voc", "facility_vertical", "voc_pct"), ("dart", "facility_vertical", "dart_pct")])
    return f.withColumn("size", S.band_score(F.col("employee_count"), BANDS)).withColumn("score", S.weighted(WEIGHTS))


@query(
    f"""WITH {_SCORED}, a AS (SELECT account_id, round(sum(CASE WHEN score >= 35 THEN score ELSE 0 END), 4) AS ceiling, count(*) AS places,
  round(max(score), 4) AS best FROM scored GROUP BY account_id) SELECT * FROM a ORDER BY ceiling DESC, account_id LIMIT 50"""
)
def q_flagship_score_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted score of each place, missing signals as 0, summed to parents; the 50 greatest."""
    a = scored(spark, sf).groupBy("account_id").agg(
        F.round(F.sum(F.when(F.col("score") >= 35, F.col("score")).otherwise(0.0)), 4).alias("ceiling"), F.count(F.lit(1)).alias("places"), F.round(F.max("score"), 4).alias("best")
    )
    return a.orderBy(F.desc("ceiling"), "account_id").limit(50)


@query(f"WITH {_F} SELECT facility_id, facility_vertical, voc, round({_pct('voc', 'facility_vertical')}, 6) AS pct FROM f")
def q_percentile_in_group(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf).select("facility_id", "facility_vertical", "voc")
    return S.group_percentile(f, "voc", "facility_vertical", "pct").withColumn("pct", F.round("pct", 6))


@query(
    """WITH d AS (SELECT award_id, CASE WHEN award_amount > -1 THEN ln(1 + award_amount) END AS v FROM dod_awards)
SELECT award_id, round(CASE WHEN v IS NOT NULL THEN (rank() OVER (ORDER BY v NULLS LAST) - 1 + (count(v) OVER (PARTITION BY v) - 1) / 2.0)
  / greatest(count(v) OVER () - 1, 1) * 100 END, 5) AS pct FROM d"""
)
def q_percentile_global_log(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dod_awards").select("award_id", F.when(F.col("award_amount") > -1, F.log(F.lit(1.0) + F.col("award_amount"))).alias("v"))
    return S.group_percentile(d, "v", None, "pct").select("award_id", F.round("pct", 5).alias("pct"))


@query(
    f"""WITH {_F}, m AS (SELECT facility_vertical, median(dart) AS m FROM f WHERE dart IS NOT NULL AND facility_vertical IS NOT NULL GROUP BY 1)
SELECT facility_id, dart, round(m, 6) AS sector_median, CASE WHEN m > 0 THEN round(dart / m, 4) END AS multiple FROM f LEFT JOIN m USING (facility_vertical)"""
)
def q_group_median_ratio(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf)
    m = S.exact_median(f, "facility_vertical", "dart").select("facility_vertical", F.col("median").alias("m"))
    multiple = F.when(F.col("m") > 0, F.round(F.col("dart") / F.col("m"), 4))
    return f.join(checked_broadcast(m), "facility_vertical", "left").select("facility_id", "dart", F.round("m", 6).alias("sector_median"), multiple.alias("multiple"))


@query(
    f"""WITH {_F}, r AS (SELECT facility_vertical, employee_count / voc AS x FROM f WHERE voc > 0.1 AND employee_count > 0 AND facility_vertical IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY facility_vertical ORDER BY x) AS k, count(*) OVER (PARTITION BY facility_vertical) AS n FROM r)
SELECT facility_vertical, round(x, 6) AS upper_median, n FROM k WHERE k = floor(n / 2) + 1 AND n >= 3"""
)
def q_upper_median_min3(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf).filter((F.col("voc") > 0.1) & (F.col("employee_count") > 0)).withColumn("x", F.col("employee_count") / F.col("voc"))
    return S.upper_median(f, "facility_vertical", "x").withColumn("upper_median", F.round("upper_median", 6))


@query(
    """WITH k AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size > 0)
SELECT p_brand, n, p_size AS upper_median FROM k WHERE k = floor(n / 2) + 1 AND n >= 3"""
)
def q_upper_median_int(spark: SparkSession, sf: str) -> DataFrame:
    return S.upper_median(table(spark, sf, "part").filter("p_size > 0"), "p_brand", "p_size")


@query(f"WITH {_F} SELECT facility_id, employee_count, {_BAND} AS band FROM f")
def q_band_score(spark: SparkSession, sf: str) -> DataFrame:
    return facilities(spark, sf).select("facility_id", "employee_count", S.band_score(F.col("employee_count"), BANDS).alias("band"))


POINTS = [(0.0, 12.0), (20.0, 16.0), (45.0, 24.0), (70.0, 28.0), (100.0, 32.0)]


@query(
    f"""WITH {_SCORED} SELECT facility_id, CAST(floor(CASE WHEN s3 <= 0 THEN 12 WHEN s3 <= 20 THEN 12 + s3 * (4.0 / 20) WHEN s3 <= 45 THEN 16 + (s3 - 20) * (8.0 / 25)
  WHEN s3 <= 70 THEN 24 + (s3 - 45) * (4.0 / 25) WHEN s3 <= 100 THEN 28 + (s3 - 70) * (4.0 / 30) ELSE 32 END) AS BIGINT) AS cap
FROM (SELECT facility_id, round((size + coalesce(voc_pct, 0) + CASE WHEN has_air_major_permit THEN 100 ELSE 0 END) / 3, 3) AS s3 FROM scored)"""
)
def q_interp_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of three signals, missing as 0, and the capacity interpolated from it."""
    mean = (F.col("size") + F.coalesce("voc_pct", F.lit(0.0)) + F.when(F.col("has_air_major_permit"), 100.0).otherwise(0.0)) / 3
    return scored(spark, sf).select("facility_id", S.interpolated(F.round(mean, 3), POINTS).alias("cap"))


@query("SELECT establishment_id, year, CASE WHEN annual_average_employees <= 41250 THEN annual_average_employees END AS employees, coalesce(annual_average_employees > 41250, false) AS suspect FROM osha_establishments")
def q_sanity_cap(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("annual_average_employees")
    return table(spark, sf, "osha_establishments").select("establishment_id", "year", S.capped(n, 41_250).alias("employees"), F.coalesce(n > 41_250, F.lit(False)).alias("suspect"))


@query(
    f"""WITH {_F}, e AS (SELECT facility_id, employee_count AS a, voc * 2 AS b, pm10_tons_2020 * 3 AS c FROM f)
SELECT facility_id, round(coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0), 0), 6) AS estimate,
  CASE WHEN coalesce(a, 0) <> 0 THEN 'actual' WHEN coalesce(b, 0) <> 0 THEN 'voc_estimated' WHEN coalesce(c, 0) <> 0 THEN 'pm_estimated' ELSE 'no_estimate' END AS basis FROM e"""
)
def q_fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable of several estimates (zero is none) and which it was."""
    value, basis = S.first_estimate(("actual", F.col("employee_count")), ("voc_estimated", F.col("voc") * 2), ("pm_estimated", F.col("pm10_tons_2020") * 3))
    return facilities(spark, sf).select("facility_id", F.round(value, 6).alias("estimate"), basis.alias("basis"))


@query(
    f"""WITH {_F}, e AS (SELECT CASE WHEN coalesce(employee_count, 0) <> 0 THEN 'actual' WHEN coalesce(voc, 0) <> 0 THEN 'voc_estimated' ELSE 'no_estimate' END AS basis FROM f)
SELECT basis, count(*) AS n FROM e GROUP BY basis"""
)
def q_basis_histogram(spark: SparkSession, sf: str) -> DataFrame:
    _, basis = S.first_estimate(("actual", F.col("employee_count")), ("voc_estimated", F.col("voc")))
    return facilities(spark, sf).groupBy(basis.alias("basis")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT establishment_id, year, CASE WHEN total_hours_worked > 0 THEN round((total_dafw_cases + total_djtr_cases) * 200000.0 / total_hours_worked, 6) END AS dart,
  CASE WHEN total_hours_worked > 0 THEN round((total_dafw_cases + total_djtr_cases + total_other_cases) * 200000.0 / total_hours_worked, 6) END AS trc FROM osha_establishments"""
)
def q_rates_guarded(spark: SparkSession, sf: str) -> DataFrame:
    hours, dart = F.col("total_hours_worked"), F.col("total_dafw_cases") + F.col("total_djtr_cases")
    o = table(spark, sf, "osha_establishments")
    return o.select("establishment_id", "year", F.round(S.rate(dart, hours), 6).alias("dart"), F.round(S.rate(dart + F.col("total_other_cases"), hours), 6).alias("trc"))


@query(f"WITH {_F} SELECT facility_id, CAST((voc IS NOT NULL) AS INT) + CAST((dart IS NOT NULL) AS INT) + CAST((employee_count IS NOT NULL) AS INT) + CAST((dod_awards_here_ttm IS NOT NULL) AS INT) AS present FROM f")
def q_signals_present(spark: SparkSession, sf: str) -> DataFrame:
    n = sum((F.col(c).isNotNull().cast("int") for c in ("voc", "dart", "employee_count", "dod_awards_here_ttm")), F.lit(0))
    return facilities(spark, sf).select("facility_id", n.alias("present"))


@query(f"WITH {_F} SELECT facility_id, round(voc / max(voc) OVER (PARTITION BY facility_vertical), 8) AS share FROM f WHERE voc > 0")
def q_share_of_max(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf).filter("voc > 0")
    top = f.groupBy(F.col("facility_vertical").alias("v")).agg(F.max("voc").alias("top"))
    return f.join(checked_broadcast(top), F.col("facility_vertical").eqNullSafe(F.col("v"))).select("facility_id", F.round(F.col("voc") / F.col("top"), 8).alias("share"))


# --- ingest shapes ----------------------------------------------------------------------------------------------


@query(
    """SELECT eis_facility_id, max(CASE WHEN pollutant_code = 'VOC' AND nei_year = 2017 THEN total_emissions END) AS voc_2017, max(CASE WHEN pollutant_code = 'VOC' AND nei_year = 2020 THEN total_emissions END) AS voc_2020,
  max(CASE WHEN pollutant_code = 'PM10-PRI' AND nei_year = 2020 THEN total_emissions END) AS pm10_2020 FROM nei_summary WHERE pollutant_code IN ('VOC', 'PM10-PRI') GROUP BY 1"""
)
def q_pivot_conditional_max(spark: SparkSession, sf: str) -> DataFrame:
    code, year = F.col("pollutant_code"), F.col("nei_year")
    n = table(spark, sf, "nei_summary").filter(code.isin("VOC", "PM10-PRI"))
    wanted = {"voc_2017": (code == "VOC") & (year == 2017), "voc_2020": (code == "VOC") & (year == 2020), "pm10_2020": (code == "PM10-PRI") & (year == 2020)}
    return R.pivot_max(n, "eis_facility_id", wanted, "total_emissions")


_EIS = "e AS (SELECT *, regexp_extract(program_system_ids_raw, 'EIS:([0-9]+)', 1) AS eis FROM frs_facilities_raw)"
_YEARS = """y7 AS (SELECT eis_facility_id AS k, max(total_emissions) AS a FROM nei_summary WHERE pollutant_code = 'VOC' AND nei_year = 2017 GROUP BY 1),
y0 AS (SELECT eis_facility_id AS k, max(total_emissions) AS b FROM nei_summary WHERE pollutant_code = 'VOC' AND nei_year = 2020 GROUP BY 1)"""


def _with_eis(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "frs_facilities_raw").withColumn("eis", F.regexp_extract("program_system_ids_raw", "EIS:([0-9]+)", 1))


@query(
    f"""WITH {_EIS}, {_YEARS}, j AS (SELECT registry_id, a, b, CASE WHEN a <> 0 THEN (b - a) / a END AS c FROM e LEFT JOIN y7 ON e.eis = y7.k AND e.eis <> '' LEFT JOIN y0 ON e.eis = y0.k AND e.eis <> '')
SELECT registry_id, a AS voc_2017, b AS voc_2020, round(c, 6) AS change, CASE WHEN c IS NULL THEN 'no_data' WHEN c > 0.05 THEN 'up' WHEN c < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM j"""
)
def q_trend_case(spark: SparkSession, sf: str) -> DataFrame:
    e, n = _with_eis(spark, sf), table(spark, sf, "nei_summary").filter("pollutant_code = 'VOC'")
    for year, name in ((2017, "a"), (2020, "b")):
        y = n.filter(F.col("nei_year") == year).groupBy(F.col("eis_facility_id").alias("k")).agg(F.max("total_emissions").alias(name))
        e = e.join(y, (F.col("eis") == F.col("k")) & (F.col("eis") != ""), "left").drop("k")
    c = S.relative_change(F.col("a"), F.col("b"))
    return e.select("registry_id", F.col("a").alias("voc_2017"), F.col("b").alias("voc_2020"), F.round(c, 6).alias("change"), S.trend(c).alias("trend"))


@query(f"WITH {_EIS} SELECT registry_id, coalesce(eis, '') AS eis, program_system_ids_raw IS NOT NULL AS has_ids FROM e")
def q_regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _with_eis(spark, sf).select("registry_id", F.coalesce("eis", F.lit("")).alias("eis"), F.col("program_system_ids_raw").isNotNull().alias("has_ids"))


@query("SELECT establishment_id, array_to_string(list_sort(list(DISTINCT naics_code) FILTER (WHERE naics_code IS NOT NULL)), ',') AS codes FROM osha_establishments WHERE establishment_id IS NOT NULL AND naics_code IS NOT NULL GROUP BY 1")
def q_list_distinct(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").filter("establishment_id is not null and naics_code is not null")
    return R.distinct_lists(o, "establishment_id", "naics_code", "codes").withColumn("codes", F.array_join("codes", ","))


@query("WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') SELECT o_orderkey, m.l_orderkey IS NOT NULL AS returned FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")
def q_flag_join(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'F'").select("l_orderkey").distinct()
    return table(spark, sf, "orders").join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNotNull().alias("returned"))


@query(
    """SELECT registry_id, CASE WHEN upper(facility_name) LIKE '%KEYSTONE%' AND state IN ('CO', 'TX') THEN 'keystone' WHEN upper(facility_name) LIKE '%MARINE%' OR upper(facility_name) LIKE '%BOATWORKS%' THEN 'water' END AS account
FROM frs_facilities_raw WHERE (upper(facility_name) LIKE '%KEYSTONE%' AND state IN ('CO', 'TX')) OR upper(facility_name) LIKE '%MARINE%' OR upper(facility_name) LIKE '%BOATWORKS%'"""
)
def q_struct_case_rules(spark: SparkSession, sf: str) -> DataFrame:
    name = F.upper("facility_name")
    rules = [(name.contains("KEYSTONE") & F.col("state").isin("CO", "TX"), {"account": "keystone"}), (name.contains("MARINE") | name.contains("BOATWORKS"), {"account": "water"})]
    e = table(spark, sf, "frs_facilities_raw").withColumn("depot", R.rule_struct(rules))
    return e.filter("depot is not null").select("registry_id", "depot.account")


@query(
    """WITH a AS (SELECT DISTINCT registry_id, array_to_string(list_sort(matched_naics_codes), ',') AS codes FROM frs_facilities_raw WHERE len(matched_naics_codes) > 0)
SELECT registry_id, codes FROM a UNION SELECT registry_id, '' FROM frs_facilities_raw e WHERE has_air_major_permit AND NOT EXISTS (SELECT 1 FROM a WHERE a.registry_id = e.registry_id)"""
)
def q_union_distinct_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "frs_facilities_raw")
    a = e.filter(F.size("matched_naics_codes") > 0).select("registry_id", F.array_sort("matched_naics_codes").alias("codes")).distinct()
    rest = e.filter("has_air_major_permit").join(a.select("registry_id").distinct(), "registry_id", "left_anti").select("registry_id", F.array().cast("array<string>").alias("codes"))
    return a.union(rest).distinct().select("registry_id", F.array_join("codes", ",").alias("codes"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT account_key, naics_code, recipient_city, award_amount FROM dod_awards WHERE naics_code IN ('336413', '332812') AND award_amount > 0")
def q_code_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dod_awards").filter(F.col("naics_code").isin("336413", "332812") & (F.col("award_amount") > 0)).select("account_key", "naics_code", "recipient_city", "award_amount")


@query(
    """SELECT award_id, naics_code, account_key, award_amount FROM (SELECT *, row_number() OVER (PARTITION BY naics_code, award_id
  ORDER BY award_date DESC NULLS LAST, award_amount DESC NULLS LAST, account_key DESC NULLS LAST, recipient_zip DESC NULLS LAST) AS k FROM dod_awards) WHERE k = 1"""
)
def q_dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col(c) for c in ("award_date", "award_amount", "account_key", "recipient_zip")]
    return R.last_wins(table(spark, sf, "dod_awards"), ["naics_code", "award_id"], order).select("award_id", "naics_code", "account_key", "award_amount")


@query("SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT year, count(*) AS n, count(*) FILTER (WHERE establishment_id IS NULL) AS no_id, count(*) FILTER (WHERE company_name IS NULL) AS no_company FROM osha_establishments GROUP BY year")
def q_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments")
    return o.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("establishment_id").isNull()).alias("no_id"), F.count_if(F.col("company_name").isNull()).alias("no_company"))


@query(
    """SELECT 'epa' AS source, registry_id AS source_id, facility_name AS name, NULL AS account_name, city, state FROM frs_facilities_raw
UNION ALL SELECT 'osha', establishment_id, establishment_name, company_name, city, state FROM osha_establishments"""
)
def q_envelope_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "frs_facilities_raw").select(F.lit("epa").alias("source"), F.col("registry_id").alias("source_id"), F.col("facility_name").alias("name"), "city", "state")
    o = table(spark, sf, "osha_establishments").select(
        F.lit("osha").alias("source"), F.col("establishment_id").alias("source_id"), F.col("establishment_name").alias("name"), F.col("company_name").alias("account_name"), "city", "state"
    )
    return e.unionByName(o, allowMissingColumns=True)


@query(
    """SELECT award_id, CAST(try_cast(award_date AS DATE) AS VARCHAR) AS day, date_diff('day', DATE '2024-01-01', try_cast(award_date AS DATE)) AS days
FROM dod_awards WHERE try_cast(award_date AS DATE) BETWEEN DATE '2026-06-30' - 730 AND DATE '2026-06-30'"""
)
def q_trailing_window(spark: SparkSession, sf: str) -> DataFrame:
    day, end = F.expr("try_cast(award_date as date)"), F.lit("2026-06-30").cast("date")
    d = table(spark, sf, "dod_awards").filter(day.between(F.date_sub(end, 730), end))
    return d.select("award_id", day.cast("string").alias("day"), F.datediff(day, F.lit("2024-01-01").cast("date")).cast("long").alias("days"))


# --- names ------------------------------------------------------------------------------------------------------

_KEY = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(replace(upper({0}), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), "
    r"'\b(INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|LLC|LLP|LP|LTD|LIMITED|PLC|GROUP|HOLDINGS|ENTERPRISES|INDUSTRIES|THE)\b', ' ', 'g'), '\s+', ' ', 'g'))"
)


@query(f"SELECT DISTINCT company_name, {_KEY.format('company_name')} AS key FROM osha_establishments WHERE company_name IS NOT NULL")
def q_normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").filter("company_name is not null").select("company_name").distinct()
    return o.withColumn("key", T.company_key(F.col("company_name")))


@query(
    r"""WITH n AS (SELECT DISTINCT facility_name, upper(trim(facility_name, ' ')) AS u FROM frs_facilities_raw WHERE facility_name IS NOT NULL),
c AS (SELECT facility_name, CASE WHEN regexp_matches(regexp_extract(u, '^([A-Z0-9]{2,})\s*-\s*', 1), '[0-9]') THEN regexp_replace(u, '^[A-Z0-9]{2,}\s*-\s*', '') ELSE u END AS u FROM n)
SELECT facility_name, regexp_replace(u, '^(THE|A|AN)\s+', '') AS identity FROM c"""
)
def q_identity_prefix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "frs_facilities_raw").filter("facility_name is not null").select("facility_name").distinct()
    return e.withColumn("identity", T.identity_prefix(F.col("facility_name")))


_STATES = ", ".join(f"'{s}'" for s in T.STATES)
_LABELS = "|".join(T.SITE_LABELS)
_SHAPED = (
    r"coalesce(length(trim({0}, ' ')) >= 3 AND NOT regexp_full_match(trim({0}, ' '), '[\d\s_.\-]+') AND upper(regexp_extract(trim({0}, ' '), '^[A-Za-z .''\-]+,\s*([A-Za-z][A-Za-z])(?:\s*\(\w+\))?$', 1)) NOT IN ("
    + _STATES
    + r") AND NOT regexp_full_match(trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' '), '("
    + _LABELS
    + r")\s*#?\d*'), false)"
)


@query(f"SELECT DISTINCT establishment_name, {_SHAPED.format('establishment_name')} AS shaped FROM osha_establishments")
def q_company_shape(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").select("establishment_name").distinct()
    return o.withColumn("shaped", T.company_shaped(F.col("establishment_name")))


_SHOWN = (
    r"coalesce(length(trim({0}, ' ')) >= 3 AND NOT regexp_full_match(trim({0}, ' '), '[\d\s_.\-]+') AND (upper(regexp_extract(trim({0}, ' '), '^[A-Za-z .''\-]+,\s*([A-Za-z][A-Za-z])$', 1)) NOT IN ("
    + _STATES
    + r") OR regexp_matches(lower(trim({0}, ' ')), ',\s*(inc|llc|lp|co|corp|ltd|plc)\.?$')) AND NOT regexp_full_match(lower(trim({0}, ' ')), '(\d+\s+)?[\w.]+(\s+[\w.]+){{0,2}}\s+(st|rd|dr|ave|ln|blvd|hwy|ct|pl|way)\.?')"
    r" AND NOT regexp_full_match(trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' '), '("
    + _LABELS
    + r")(\s*#?\d+)?'), false)"
)


@query(
    f"""SELECT DISTINCT establishment_name, company_name, city, CASE WHEN {_SHOWN.format('establishment_name')} THEN trim(establishment_name, ' ') WHEN {_SHOWN.format('company_name')} THEN trim(company_name, ' ')
  WHEN coalesce(city, '') <> '' THEN 'Unnamed — ' || city ELSE 'Unnamed' END AS shown FROM osha_establishments"""
)
def q_display_name_fallback(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").select("establishment_name", "company_name", "city").distinct()
    return o.withColumn("shown", T.shown_name(F.col("establishment_name"), F.col("company_name"), F.lit("Unnamed"), F.col("city")))


@query()
def q_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of the two names of each filing; no SQL has this ratio, tests hold it against the standard library."""
    o = table(spark, sf, "osha_establishments").filter("company_name is not null").select("establishment_name", "company_name").distinct()
    return o.withColumn("similarity", T.name_similarity(F.col("establishment_name"), F.col("company_name")))


PATTERNS = {"keystone": ["NUNINDSTROM"], "troskencrest": ["TROSKENCREST"], "dolomock": ["DOLOMOCK", "DOLOMOCK ONYX"]}
ALIASES = {"NUNINDSTROM KEYSTONE FORGE": "keystone_forge"}


@query(
    r"""WITH n AS (SELECT DISTINCT recipient_name, regexp_replace(upper(trim(recipient_name, ' ')), '^(THE|A|AN)\s+', '') AS u FROM dod_awards WHERE recipient_name IS NOT NULL)
SELECT recipient_name, CASE WHEN regexp_matches(u, '^NUNINDSTROM([^A-Z0-9]|$)') THEN 'keystone' WHEN regexp_matches(u, '^TROSKENCREST([^A-Z0-9]|$)') THEN 'troskencrest' WHEN regexp_matches(u, '^DOLOMOCK([^A-Z0-9]|$)') THEN 'dolomock' END AS company FROM n"""
)
def q_company_patterns(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dod_awards").filter("recipient_name is not null").select("recipient_name").distinct()
    return d.withColumn("company", T.first_company(F.col("recipient_name"), PATTERNS))


@query(
    f"""WITH e AS (SELECT 'osha' AS source, establishment_id AS source_id, {_KEY.format("coalesce(nullif(company_name, ''), establishment_name, '')")} AS k FROM osha_establishments)
SELECT source_id, CASE WHEN k = 'NUNINDSTROM KEYSTONE FORGE' THEN 'keystone_forge' WHEN k <> '' THEN k ELSE '_unnamed_osha_' || coalesce(source_id, '') END AS account FROM e"""
)
def q_account_assignment(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").withColumns({"source": F.lit("osha"), "source_id": F.col("establishment_id")})
    return V.assign_accounts(o, ALIASES, "establishment_name", "company_name").select("source_id", "account")


@query(
    """SELECT award_id, award_amount, n || CASE WHEN n % 100 BETWEEN 10 AND 20 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
  CASE WHEN concat_ws('. ', CASE WHEN award_amount > 0 THEN 'Awarded' END, CASE WHEN pop_city IS NOT NULL THEN 'Work in ' || pop_city END) = '' THEN 'No signal.'
    ELSE concat_ws('. ', CASE WHEN award_amount > 0 THEN 'Awarded' END, CASE WHEN pop_city IS NOT NULL THEN 'Work in ' || pop_city END) || '.' END AS why
FROM (SELECT *, CAST(length(recipient_name) AS INT) AS n FROM dod_awards)"""
)
def q_why_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dod_awards")
    why = T.sentences(F.when(F.col("award_amount") > 0, "Awarded"), F.when(F.col("pop_city").isNotNull(), F.concat(F.lit("Work in "), "pop_city")), default="No signal.")
    return d.select("award_id", "award_amount", T.ordinal(F.length("recipient_name")).alias("place"), why.alias("why"))


# --- resolving --------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf).filter("lat between -90 and 90 and lon between -180 and 180")
    return f.select(F.col("account_id").alias("account"), F.col("facility_id").alias("id"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")).distinct()


_P = f"{_F}, p AS (SELECT DISTINCT account_id AS account, facility_id AS id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM f WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"
_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH {_P} SELECT a.account, a.id AS id_a, b.id AS id_b, round({_HAV}, 2) AS metres FROM p a JOIN p b ON a.account = b.account AND a.id < b.id AND abs(a.lat - b.lat) < 0.0068 WHERE {_HAV} <= 750")
def q_haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return V.near_in_bucket(_points(spark, sf)).withColumn("metres", F.round("metres", 2))


@query(f"WITH {_P}, d AS (SELECT a.account AS grp, a.id AS id_a, b.id AS id_b, round({_HAV}, 1) AS metres FROM p a JOIN p b ON a.account = b.account AND a.id < b.id ) SELECT grp, max(metres) AS metres FROM d GROUP BY grp")
def q_cluster_diameter(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of any size."""
    return V.diameters(_points(spark, sf).withColumnRenamed("account", "grp")).select("grp", F.round("metres", 1).alias("metres"))


@query("WITH c AS (SELECT account_id, count(*) AS n FROM facilities GROUP BY 1) SELECT n > 500 AS oversized, count(*) AS accounts, CAST(sum(n) AS BIGINT) AS records FROM c GROUP BY 1")
def q_oversize_guard(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "facilities").select(F.col("account_id").alias("account"))
    return V.split_oversized(f).groupBy("oversized").agg(F.countDistinct("account").alias("accounts"), F.count(F.lit(1)).alias("records"))


def _cluster_input(spark: SparkSession, sf: str) -> DataFrame:
    f = facilities(spark, sf).dropDuplicates(["facility_id"])
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    key = F.when(F.col("address").rlike("^[0-9]+ "), F.concat_ws(" ", F.upper(T.squeezed(F.col("address"))), F.upper("city"), F.upper("state")))
    return f.select(F.col("account_id").alias("account"), F.col("facility_id").alias("id"), F.col("facility_name").alias("name"), key.alias("address_key"), F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lon")).alias("lon"))


@query()
def q_cluster_full(spark: SparkSession, sf: str) -> DataFrame:
    """Tiered clusters; the result depends on the order of pairs, so tests hold it against a brute-force version."""
    return V.cluster(_cluster_input(spark, sf))[0]


@query()
def q_cluster_any_size(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all accounts, those over the guard too; tests hold them against a brute-force version."""
    return V.cluster_large(_cluster_input(spark, sf))


@query()
def q_cluster_review(spark: SparkSession, sf: str) -> DataFrame:
    return V.cluster(_cluster_input(spark, sf))[1]


@query(
    """WITH s AS (SELECT account_key AS g, upper(coalesce(pop_city, '')) AS c, upper(coalesce(pop_state, '')) AS s, sum(coalesce(award_amount, 0)) AS t, count(*) AS n FROM dod_awards GROUP BY ALL),
k AS (SELECT account_id AS g, upper(coalesce(city, '')) AS c, upper(coalesce(state, '')) AS s, count(*) > 1 AS shared FROM facilities GROUP BY ALL)
SELECT facility_id, round(s.t, 2) AS total_amount, s.n AS n_amounts, k.shared FROM facilities f LEFT JOIN s ON f.account_id = s.g AND upper(coalesce(f.city, '')) = s.c AND upper(coalesce(f.state, '')) = s.s
LEFT JOIN k ON f.account_id = k.g AND upper(coalesce(f.city, '')) = k.c AND upper(coalesce(f.state, '')) = k.s"""
)
def q_city_attribution_shared(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "facilities").select("facility_id", "account_id", "city", "state")
    d = table(spark, sf, "dod_awards").select(F.col("account_key").alias("account_id"), F.col("pop_city").alias("city"), F.col("pop_state").alias("state"), "award_amount")
    return R.attributed(f, d, "account_id", ["city", "state"], "award_amount").select("facility_id", F.round("total_amount", 2).alias("total_amount"), "n_amounts", "shared")


@query("SELECT left(recipient_zip, 5) AS zip, count(*) AS n FROM dod_awards d WHERE recipient_zip IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facilities f WHERE left(f.zip, 5) = left(d.recipient_zip, 5)) GROUP BY 1")
def q_areas_without_places(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "dod_awards").filter("recipient_zip is not null").groupBy(F.left("recipient_zip", F.lit(5)).alias("zip")).agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, sf, "facilities").filter("zip is not null").select(F.left("zip", F.lit(5)).alias("zip")).distinct()
    return d.join(f, "zip", "left_anti")


_COLLAPSE = """WITH o AS (SELECT DISTINCT establishment_id, year, dart_rate, establishment_name, city, annual_average_employees, company_name FROM osha_establishments),
k AS (SELECT *, row_number() OVER (PARTITION BY establishment_id ORDER BY year DESC, dart_rate DESC NULLS LAST, establishment_name DESC NULLS LAST, city DESC NULLS LAST, annual_average_employees DESC NULLS LAST, company_name DESC NULLS LAST) AS l,
  row_number() OVER (PARTITION BY establishment_id ORDER BY year, dart_rate NULLS FIRST, establishment_name NULLS FIRST, city NULLS FIRST, annual_average_employees NULLS FIRST, company_name NULLS FIRST) AS e FROM o)
SELECT establishment_id, max(establishment_name) FILTER (WHERE l = 1) AS establishment_name, max(city) FILTER (WHERE l = 1) AS city, max(annual_average_employees) FILTER (WHERE l = 1) AS annual_average_employees,
  max(company_name) FILTER (WHERE e = 1) AS company_name, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FILTER (WHERE establishment_id IS NOT NULL) AS years FROM k GROUP BY establishment_id"""


@query(_COLLAPSE)
def q_series_collapse(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").select("establishment_id", "year", "dart_rate", "establishment_name", "city", "annual_average_employees", "company_name").distinct()
    c = R.collapse_series(o, "establishment_id", "year", ["establishment_name", "city", "annual_average_employees"], ["company_name"], ["dart_rate"])
    return c.withColumn("years", F.array_join(F.transform("series", lambda x: x["year"].cast("string")), ",")).drop("series")


@query(
    """WITH y AS (SELECT establishment_id, year, max(dart_rate) AS d FROM osha_establishments WHERE establishment_id IS NOT NULL AND dart_rate IS NOT NULL GROUP BY 1, 2),
t AS (SELECT establishment_id, count(*) AS n, arg_min(d, year) AS a, arg_max(d, year) AS b FROM y GROUP BY 1)
SELECT establishment_id, CASE WHEN n < 2 OR a = 0 THEN 'no_data' WHEN (b - a) / a > 0.05 THEN 'up' WHEN (b - a) / a < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM t"""
)
def q_series_trend(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "osha_establishments").filter("establishment_id is not null and dart_rate is not null")
    y = o.groupBy("establishment_id", "year").agg(F.max("dart_rate").alias("d"))
    s = y.groupBy("establishment_id").agg(F.array_sort(F.collect_list(F.struct("year", "d"))).alias("series"))
    return s.select("establishment_id", R.series_trend(F.col("series"), "d").alias("trend"))


@query(
    f"""WITH {_F}, d AS (SELECT account_id, facility_id, max(voc) AS voc, max(employee_count) AS employee_count FROM f GROUP BY 1, 2)
SELECT account_id, min_by(voc, facility_id) FILTER (WHERE voc IS NOT NULL) AS first_voc, max_by(employee_count, facility_id) FILTER (WHERE employee_count IS NOT NULL) AS last_employees FROM d GROUP BY account_id"""
)
def q_first_last_present(spark: SparkSession, sf: str) -> DataFrame:
    """All accounts; of repeated rows of a facility the greatest values count."""
    d = facilities(spark, sf).groupBy("account_id", "facility_id").agg(F.max("voc").alias("voc"), F.max("employee_count").alias("employee_count"))
    return d.groupBy("account_id").agg(R.first_present("voc", "facility_id").alias("first_voc"), R.last_present("employee_count", "facility_id").alias("last_employees"))


@query(
    f"""WITH {_F}, r AS (SELECT account_id, facility_id, CASE WHEN voc > 0 THEN 'emits' WHEN has_air_major_permit THEN 'permit' WHEN employee_count >= 100 THEN 'headcount' END AS reason FROM f),
d AS (SELECT account_id, facility_id, min(reason) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1, 2) SELECT account_id, min_by(reason, facility_id) AS reason FROM d GROUP BY 1"""
)
def q_qualify_first_reason(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.col("voc") > 0, "emits").when(F.col("has_air_major_permit"), "permit").when(F.col("employee_count") >= 100, "headcount")
    d = facilities(spark, sf).select("account_id", "facility_id", reason.alias("reason")).filter("reason is not null").groupBy("account_id", "facility_id").agg(F.min("reason").alias("reason"))
    return d.groupBy("account_id").agg(F.min_by("reason", "facility_id").alias("reason"))


@query("SELECT facility_id, split_part(member_source_ids[1], ':', 1) AS source, [x[5:] FOR x IN member_source_ids IF x LIKE 'epa:%'][1] AS epa_id, split_part(facility_id, '::', 1) AS account FROM facilities")
def q_source_ids(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get("member_source_ids", F.lit(0))
    epa = F.get(F.filter("member_source_ids", lambda x: x.startswith("epa:")), F.lit(0))
    f = table(spark, sf, "facilities")
    return f.select("facility_id", F.substring_index(first, ":", 1).alias("source"), F.substring(epa, F.lit(5), F.length(epa)).alias("epa_id"), F.substring_index("facility_id", "::", 1).alias("account"))


VERTICALS = {"332812": "coating", "332323": "metal", "336413": "air", "336411": "air", "326199": "plastic"}
_VERTICAL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERTICALS.items()) + " END"


@query(f"SELECT registry_id, ([{_VERTICAL} FOR x IN list_sort(matched_naics_codes) IF {_VERTICAL} IS NOT NULL])[1] AS vertical FROM frs_facilities_raw")
def q_first_listed_code(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "frs_facilities_raw")
    return e.select("registry_id", R.first_listed(F.array_sort("matched_naics_codes"), VERTICALS).alias("vertical"))


# --- rollups ----------------------------------------------------------------------------------------------------


@query("SELECT account_id, facility_vertical, n FROM (SELECT account_id, facility_vertical, count(*) AS n, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, facility_vertical) AS k FROM facilities WHERE facility_vertical IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def q_mode_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return U.most_frequent(table(spark, sf, "facilities"), "account_id", "facility_vertical")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def q_topn(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name", "c_acctbal")


@query(f"WITH {_F} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE employee_count >= t) AS passed FROM f, (VALUES (10), (50), (100), (250)) v(t) GROUP BY t")
def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return U.sweep(facilities(spark, sf), F.col("employee_count"), [10, 50, 100, 250])


LIVE = {"voc_pct": 22.0, "dart_pct": 8.0, "size": 25.0}
_LIVE = f"""{_SCORED}, live AS (SELECT *, floor((coalesce(voc_pct, 0) * (22.0 / 55) + coalesce(dart_pct, 0) * (8.0 / 55) + coalesce(size, 0) * (25.0 / 55)) * 10 + 0.5) / 10 AS live_score FROM scored),
passed AS (SELECT *, coalesce(qualified_for_tcv AND live_score >= 35, false) AS ok, coalesce(dod_awards_here_ttm, 0.0) AS amount FROM live)"""


def _live(spark: SparkSession, sf: str) -> DataFrame:
    f = U.live_scores(scored(spark, sf), LIVE)
    return f.withColumns({"ok": F.coalesce(F.col("qualified_for_tcv") & (F.col("live_score") >= 35), F.lit(False)), "amount": F.coalesce("dod_awards_here_ttm", F.lit(0.0))})


@query(f"WITH {_LIVE} SELECT account_id, count(*) AS places, count(*) FILTER (WHERE ok) AS qualified, round(sum(CASE WHEN ok THEN amount ELSE 0 END), 2) AS amount, round(sum(CASE WHEN ok AND installed_status = 'untouched' THEN amount ELSE 0 END), 2) AS untouched_amount FROM passed GROUP BY account_id")
def q_live_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return U.rolled_up(_live(spark, sf), "account_id", F.col("ok"), F.col("installed_status"), F.col("amount"))


@query(f"WITH {_LIVE}, a AS (SELECT account_id, sum(amount) FILTER (WHERE ok) AS t, count(*) FILTER (WHERE ok) AS n FROM passed GROUP BY 1) SELECT count(*) AS accounts, count(*) FILTER (WHERE t >= 20000000) AS great, round(sum(t), 2) AS total, CAST(sum(n) AS BIGINT) AS qualified FROM a")
def q_headline(spark: SparkSession, sf: str) -> DataFrame:
    a = _live(spark, sf).groupBy("account_id").agg(F.sum(F.when(F.col("ok"), F.col("amount"))).alias("t"), F.count_if("ok").alias("n"))
    return a.agg(F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("t") >= 20_000_000).alias("great"), F.round(F.sum("t"), 2).alias("total"), F.sum("n").alias("qualified"))


@query(
    """WITH p AS (SELECT r_name AS region, c_custkey, round(sum(o_totalprice), 2) AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY a DESC, c_custkey) AS k FROM p)
SELECT region, count(*) AS parents, round(sum(a), 2) AS amount, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) AS top FROM k GROUP BY region"""
)
def q_region_top5(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    where = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(checked_broadcast(where), F.col("c_nationkey") == F.col("n_nationkey"))
    top = U.region_top(j.select("region", "c_custkey", "o_totalprice"), "region", "c_custkey", "o_totalprice")
    return top.withColumn("top", F.array_join(F.transform("top", lambda x: x.cast("string")), ","))


@query(f"WITH {_F} SELECT coalesce(state, '??') AS state, count(*) AS n, round(sum(coalesce(dod_awards_here_ttm, 0)), 2) AS amount, round(avg(CASE WHEN NOT suspect_coordinates THEN lat END), 6) AS lat, round(avg(CASE WHEN NOT suspect_coordinates THEN lon END), 6) AS lon FROM f GROUP BY 1")
def q_state_clusters(spark: SparkSession, sf: str) -> DataFrame:
    sure = ~F.col("suspect_coordinates")
    return facilities(spark, sf).groupBy(F.coalesce("state", F.lit("??")).alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("dod_awards_here_ttm", F.lit(0.0))), 2).alias("amount"), F.round(F.avg(F.when(sure, F.col("lat"))), 6).alias("lat"), F.round(F.avg(F.when(sure, F.col("lon"))), 6).alias("lon")
    )


@query(f"WITH {_F} SELECT count(*) FILTER (WHERE NOT suspect_coordinates AND lat IS NOT NULL AND lon IS NOT NULL) AS shown, count(*) FILTER (WHERE suspect_coordinates OR lat IS NULL OR lon IS NULL) AS left_out FROM f")
def q_visible_points(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.coalesce(~F.col("suspect_coordinates") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.lit(False))
    return facilities(spark, sf).agg(F.count_if(ok).alias("shown"), F.count_if(~ok).alias("left_out"))


@query("SELECT o_custkey, CAST(floor(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / coalesce(nullif(count(*), 0), 1) + 0.5) AS BIGINT) AS done_share, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def q_status_share(spark: SparkSession, sf: str) -> DataFrame:
    share = F.floor(F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)) + 0.5)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(share.alias("done_share"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 1), event_id) AS pos FROM events WHERE event_type = 'error'")
def q_review_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each group with the group's size and their place in it; rows, not collected lists."""
    e = table(spark, sf, "events").filter("event_type = 'error'")
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy(F.coalesce("value", F.lit(1.0)), "event_id"))
    return e.select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("n"), place.alias("pos"))


_AB = "s AS (SELECT s_suppkey, s_acctbal AS before, s_acctbal * (1 + (s_suppkey % 7) / 10.0) AS after FROM supplier)"


@query(f"WITH {_AB}, a AS (SELECT s_suppkey AS x, row_number() OVER (ORDER BY before DESC, s_suppkey) AS k FROM s), b AS (SELECT s_suppkey AS y, row_number() OVER (ORDER BY after DESC, s_suppkey) AS k FROM s) SELECT count(*) FILTER (WHERE x <> y) AS moved FROM a JOIN b USING (k)")
def q_rank_churn(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("before"), (F.col("s_acctbal") * (1 + (F.col("s_suppkey") % 7) / 10.0)).alias("after"))
    return U.churn(s, "s_suppkey", "before", "after")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS step, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def q_expansion_path(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    running = F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("step"), running.alias("running"))


@query("SELECT s_suppkey AS id, s_name AS name, 'cache' AS basis FROM supplier UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def q_enrichment_merge(spark: SparkSession, sf: str) -> DataFrame:
    cache = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("cache").alias("basis"))
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("new").alias("basis"))
    return R.enrich_once(cache, new, "id")


def _signal(value: Column, source: str) -> Column:
    return F.struct(value.isNotNull().alias("present"), F.coalesce(F.format_string("%.1f", value), F.lit("none")).alias("raw"), F.lit(source).alias("source"))


@query(
    f"""WITH {_F} SELECT facility_id, facility_name, voc IS NOT NULL AS voc_present, dart IS NOT NULL AS dart_present, coalesce(CAST(CAST(employee_count AS BIGINT) AS VARCHAR), 'none') AS size_raw, 'injuries' AS size_source FROM f"""
)
def q_nested_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Places as nested records through JSON and back; the fields are compared, as JSON texts differ between engines."""
    f = facilities(spark, sf)
    size = F.struct(F.col("employee_count").isNotNull().alias("present"), F.coalesce(F.col("employee_count").cast("long").cast("string"), F.lit("none")).alias("raw"), F.lit("injuries").alias("source"))
    signals = F.struct(_signal(F.col("voc"), "emissions").alias("voc"), _signal(F.col("dart"), "injuries").alias("dart"), size.alias("size"))
    j = f.select("facility_id", F.to_json(F.struct("facility_name", signals.alias("signals")), {"ignoreNullFields": "false"}).alias("json"))
    one = "struct<present:boolean,raw:string,source:string>"
    back = j.select("facility_id", F.from_json("json", f"facility_name string, signals struct<voc:{one},dart:{one},size:{one}>").alias("r"))
    return back.select("facility_id", "r.facility_name", F.col("r.signals.voc.present").alias("voc_present"), F.col("r.signals.dart.present").alias("dart_present"), F.col("r.signals.size.raw").alias("size_raw"), F.col("r.signals.size.source").alias("size_source"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the batch operators: the plan of the streaming totals, over a bounded table."""
    return windowed_totals(table(spark, sf, "events"))
