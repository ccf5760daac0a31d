"""Queries of the general problems over the supplied tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.badrows import classify_lines, loaded, rejects
from ..operators.proximity import near_pairs, regions_holding, usable_point
from ..runtime import table

NUMBER_COLUMNS = ("annual_average_employees", "total_hours_worked")
NEAR_M = 200.0
#: The columns of a record, in the order of the oldest header.
COLUMNS = (
    "id", "establishment_name", "establishment_id", "ein", "company_name", "street_address", "city", "state", "zip_code", "naics_code", "naics_year", "industry_description", "establishment_type",
    "size", "annual_average_employees", "total_hours_worked", "no_injuries_illnesses", "total_deaths", "total_dafw_cases", "total_djtr_cases", "total_other_cases", "total_dafw_days",
    "total_djtr_days", "total_injuries", "total_skin_disorders", "total_respiratory_conditions", "total_poisonings", "total_hearing_loss", "total_other_illnesses", "created_timestamp",
    "change_reason", "year_filing_for",
)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facilities").filter(~F.col("suspect_coordinates")).select("facility_id", "latitude", "longitude")
    return near_pairs(f, NEAR_M, "facility_id", "latitude", "longitude").select(F.col("id_a").alias("facility_a"), F.col("id_b").alias("facility_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(classify_lines(table(spark, sf_dir, "osha_ita_lines"), NUMBER_COLUMNS))


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(classify_lines(table(spark, sf_dir, "osha_ita_lines"), NUMBER_COLUMNS), COLUMNS, NUMBER_COLUMNS)


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of each record that doesn't load."""
    c = classify_lines(table(spark, sf_dir, "osha_ita_lines"), NUMBER_COLUMNS)
    return c.filter(F.size("errors") > 0).select("line_id", F.array_join("errors", "; ").alias("reasons"))


def p3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facility, region): the regions that hold each located row; regions are here the diamonds in the boxes of the states."""
    f = table(spark, sf_dir, "facilities").filter(~F.col("suspect_coordinates"))
    ok = f.filter(usable_point(F.col("latitude"), F.col("longitude")))
    box = ok.filter("state is not null").groupBy(F.col("state").alias("region")).agg(*(g(c).alias(f"{g.__name__}_{c[:3]}") for g in (F.min, F.max) for c in ("latitude", "longitude")))
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    corner = lambda a, o: F.struct(a.alias("lat"), o.alias("lon"))
    regions = box.select("region", F.array(corner(F.col("min_lat"), lon), corner(lat, F.col("max_lon")), corner(F.col("max_lat"), lon), corner(lat, F.col("min_lon"))).alias("ring"))
    return regions_holding(f, regions, "facility_id", "latitude", "longitude").withColumnRenamed("id", "facility")


QUERIES = {"p3_found": p3_found, "p3_regions": p3_regions, "p6_found": p6_found, "p6_loaded": p6_loaded, "p6_reasons": p6_reasons}

_LINES = r"""
WITH h AS (SELECT source_file, string_split(min(line), ',') AS header FROM osha_ita_lines WHERE line_no = 1 GROUP BY 1),
l AS (SELECT line_id, source_file, coalesce(line, '') AS line, header,
        NOT regexp_full_match(coalesce(line, ''), '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS broken
      FROM osha_ita_lines LEFT JOIN h USING (source_file) WHERE line_no <> 1),
f AS (SELECT *, length(q) - length(replace(q, ',', '')) + 1 AS n,
        regexp_extract_all(line, '(?s)(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1) AS fields
      FROM (SELECT *, regexp_replace(line, '(?s)"[^"]*"', '', 'g') AS q FROM l)),
v AS (SELECT *, [replace(CASE WHEN x LIKE '"%' THEN x[2:-2] ELSE x END, '""', '"') FOR x IN fields] AS vals FROM f),
w AS (SELECT *, trim(vals[list_position(header, 'annual_average_employees')], ' ') AS e,
        trim(vals[list_position(header, 'total_hours_worked')], ' ') AS t FROM v),
b AS (SELECT *,
        e <> '' AND NOT (regexp_full_match(e, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(e AS DOUBLE) >= 0 AND try_cast(e AS DOUBLE) < 'inf'::DOUBLE, false)) AS bad_e,
        t <> '' AND NOT (regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(t AS DOUBLE) >= 0 AND try_cast(t AS DOUBLE) < 'inf'::DOUBLE, false)) AS bad_t FROM w),
j AS (SELECT *, CASE WHEN broken THEN 'broken_quoting' WHEN n <> len(header) THEN 'column_count'
        WHEN (e <> '' AND NOT (regexp_full_match(e, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(e AS DOUBLE) >= 0 AND try_cast(e AS DOUBLE) < 'inf'::DOUBLE, false)))
          OR (t <> '' AND NOT (regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(t AS DOUBLE) >= 0 AND try_cast(t AS DOUBLE) < 'inf'::DOUBLE, false)))
        THEN 'invalid_value' END AS reason FROM b)
"""
_CELL = "nullif(trim(vals[list_position(header, '{0}')], ' '), '') AS {0}"
ORACLE = {
    "p3_found": """
WITH p AS (SELECT DISTINCT facility_id AS id, latitude AS la, longitude AS lo FROM facilities
  WHERE NOT suspect_coordinates AND facility_id IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)
    AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
SELECT DISTINCT a.id AS facility_a, b.id AS facility_b FROM p a JOIN p b
  ON b.la BETWEEN a.la - 0.0018 AND a.la + 0.0018 AND a.id < b.id
WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.la - a.la) / 2), 2)
  + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 200""",
    "p6_found": _LINES + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p6_loaded": _LINES
    + "SELECT line_id, source_file, "
    + ", ".join(_CELL.format(c) for c in COLUMNS if c not in NUMBER_COLUMNS)
    + ", try_cast(nullif(e, '') AS DOUBLE) AS annual_average_employees, try_cast(nullif(t, '') AS DOUBLE) AS total_hours_worked FROM j WHERE reason IS NULL",
    "p6_reasons": _LINES
    + "SELECT line_id, CASE WHEN reason <> 'invalid_value' THEN reason ELSE concat_ws('; ', CASE WHEN bad_e THEN 'invalid_value: annual_average_employees' END, CASE WHEN bad_t THEN 'invalid_value: total_hours_worked' END) END AS reasons FROM j WHERE reason IS NOT NULL",
    "p3_regions": """
WITH p AS (SELECT facility_id, state, latitude AS la, longitude AS lo FROM facilities WHERE NOT suspect_coordinates AND NOT isnan(latitude) AND NOT isnan(longitude)
    AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180),
b AS (SELECT state AS region, (min(la) + max(la)) / 2 AS ca, (max(la) - min(la)) / 2 AS ha, (min(lo) + max(lo)) / 2 AS co, (max(lo) - min(lo)) / 2 AS ho FROM p WHERE state IS NOT NULL GROUP BY 1)
SELECT DISTINCT facility_id AS facility, region FROM p JOIN b ON abs(la - ca) * ho + abs(lo - co) * ha < ha * ho WHERE facility_id IS NOT NULL""",
}
