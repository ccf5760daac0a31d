"""Queries of the problems tagged llm over the supplied tables, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..runtime import cut, table
from .addresses import PARTS, location_links, same_location, with_parts
from .linkage import link_records, memberships
from .names import organisations, spelling_pairs
from .leakage import leaks
from .packing import audit, pack, token_sizes
from .percentiles import percentiles, value_counts
from .pii import find_details, redact


def site_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPA registrations and OSHA establishments as (record, address, city, state, zip_code)."""
    e, o = table(spark, sf_dir, "frs_facilities_raw"), table(spark, sf_dir, "osha_establishments")
    place = lambda a, z: (F.col(a).alias("address"), "city", "state", F.col(z).alias("zip_code"))
    return e.select(F.concat(F.lit("epa:"), "registry_id").alias("record"), *place("address", "zip")).unionByName(
        o.select(F.concat(F.lit("osha:"), "establishment_id").alias("record"), *place("street_address", "zip_code"))
    )


def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct strings of the three name columns, as they stand."""
    e, o = table(spark, sf_dir, "frs_facilities_raw"), table(spark, sf_dir, "osha_establishments")
    all_ = o.select(F.col("establishment_name").alias("name")).unionByName(o.select(F.col("company_name").alias("name")))
    return all_.unionByName(e.select(F.col("facility_name").alias("name"))).distinct()


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the three sources with their names and addresses."""
    e, o, d = (table(spark, sf_dir, t) for t in ("frs_facilities_raw", "osha_establishments", "dod_awards"))
    place = ("record", "source", "names", "address", "city", "state", "zip_code")
    epa = e.select(F.concat(F.lit("epa:"), "registry_id"), F.lit("epa"), F.array("facility_name"), "address", "city", "state", "zip").toDF(*place)
    osha = o.select(
        F.concat(F.lit("osha:"), "establishment_id"), F.lit("osha"), F.array("establishment_name", "company_name"), "street_address", "city", "state", "zip_code"
    ).toDF(*place)
    dod = d.select(
        F.concat(F.lit("dod:"), "account_key"), F.lit("dod"), F.array("recipient_name"), "recipient_address_line1", "recipient_city", "recipient_state", "recipient_zip"
    ).toDF(*place)
    return epa.unionByName(osha).unionByName(dod)


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_records(all_records(spark, sf_dir))


def p1_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the plant they describe: the pairs' form that grows with the records only."""
    return memberships(all_records(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_links(spark, sf_dir).select("record_a", "record_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(site_names(spark, sf_dir))


def p2_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organisations(site_names(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_location(site_records(spark, sf_dir))


def p4_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, location): all records with a street address; linked writings are one location."""
    parts = with_parts(site_records(spark, sf_dir).filter("record is not null"), "address", "city", "state", "zip_code").filter("number is not null")
    own = parts.select("record", F.xxhash64(*PARTS).alias("node"), *PARTS).distinct()
    places = components(location_links(own.select("node", *PARTS).distinct()))
    return own.select("record", "node").join(places, "node", "left").select("record", F.coalesce("place", "node").alias("location")).distinct()


MEASURES = ("voc_tons_2020", "dart_rate")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles, from day summaries that are merged."""
    days = value_counts(table(spark, sf_dir, "facilities"), "facility_vertical", MEASURES, "ingested_at")
    return percentiles(days)


def p5_percentiles_1pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within one percent of the value, from bounded summaries."""
    return percentiles(value_counts(table(spark, sf_dir, "facilities"), "facility_vertical", MEASURES, "ingested_at", 0.01))


def p5_error_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile from bounded summaries is within one percent of the exact one."""
    exact, rough = p5_percentiles(spark, sf_dir), p5_percentiles_1pct(spark, sf_dir).select(F.col("measure").alias("m"), F.col("grp").alias("g"), F.col("quantile").alias("q"), F.col("value").alias("about"))
    both = exact.join(rough, (F.col("measure") == F.col("m")) & F.col("grp").eqNullSafe(F.col("g")) & (F.col("quantile") == F.col("q")))
    return both.select("measure", "grp", "quantile", "n", (F.abs(F.col("about") - F.col("value")) <= 0.01 * F.abs(F.col("value")) + 1e-12).alias("within"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers, checked: all documents placed whole, none over capacity, hardly more than the least number."""
    sizes = cut(token_sizes(table(spark, sf_dir, "documents")))
    return audit(sizes, pack(sizes))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_details(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_links, p1_plants, p2_found, p2_organisations, p4_found, p4_locations, p5_percentiles, p5_percentiles_1pct, p5_error_bound, p7_containers, p7_audit, p8_found, p9_found, p9_redacted,
    )
}
_ENTRIES = """
WITH e AS (SELECT 'voc_tons_2020' AS measure, facility_vertical AS grp, voc_tons_2020 AS value FROM facilities
  UNION ALL SELECT 'dart_rate', facility_vertical, dart_rate FROM facilities),
r AS (SELECT measure, grp, {value} AS value, row_number() OVER (PARTITION BY measure, grp ORDER BY value) AS k,
        count(*) OVER (PARTITION BY measure, grp) AS n FROM e WHERE value IS NOT NULL AND NOT isnan(value))
SELECT measure, grp, quantile, min(value) AS value, n FROM r, (VALUES (0.5), (0.9), (0.95), (0.99)) q(quantile)
WHERE k >= greatest(1, ceil(quantile * n - 1e-9)) GROUP BY measure, grp, quantile, n"""
_BUCKET = "CASE WHEN value = 0 THEN value ELSE sign(value) * 2 * pow(1.01 / 0.99, ceil(ln(abs(value)) / ln(1.01 / 0.99))) / (1.01 / 0.99 + 1) END"
ORACLE: dict[str, str] = {
    "p5_percentiles": _ENTRIES.format(value="value").replace("SELECT measure, grp, quantile,", "SELECT measure, grp, CAST(quantile AS DOUBLE) AS quantile,"),
    "p5_percentiles_1pct": _ENTRIES.format(value=_BUCKET).replace("SELECT measure, grp, quantile,", "SELECT measure, grp, CAST(quantile AS DOUBLE) AS quantile,"),
    "p5_error_bound": "SELECT measure, grp, quantile, n, true AS within FROM (" + _ENTRIES.format(value="value").replace("SELECT measure, grp, quantile,", "SELECT measure, grp, CAST(quantile AS DOUBLE) AS quantile,") + ")",
    "p7_audit": "SELECT count(*) AS documents, 0::BIGINT AS unplaced, 0::BIGINT AS split_short, 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0 AS wasteful FROM documents",
}
