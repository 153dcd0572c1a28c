"""Queries of the general training-data operators: lines that fail to parse (3) and points near points (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators import geo, parsing
from tessaline.plans.registry import Registry
from tessaline.runtime import table

REGISTRY = Registry()

_FIELD = r'(?:"(?:[^"]|"")*"|[^"\r\n{d}]*)'
_WELL = "^" + _FIELD + "(?:{d}" + _FIELD + ")*$"

_P3_PARSED = rf"""
WITH raw AS (
  SELECT line_id, coalesce(raw_line, '') AS raw, coalesce(export_file LIKE '%.tsv', FALSE) AS tab FROM gkg_lines
), judged AS (
  SELECT line_id, raw, tab,
    CASE WHEN tab THEN regexp_matches(raw, '(?s){_WELL.format(d=chr(92) + "t").replace("^", chr(92) + "A", 1)[:-1]}\z')
         ELSE regexp_matches(raw, '(?s){_WELL.format(d=",").replace("^", chr(92) + "A", 1)[:-1]}\z') END AS well
  FROM raw
), split AS (
  SELECT line_id, well, CASE WHEN NOT well THEN [] ELSE regexp_extract_all(
      CASE WHEN tab THEN chr(9) ELSE ',' END || raw,
      CASE WHEN tab THEN '\t(?:"(?:[^"]|"")*"|[^"\r\n\t]*)' ELSE ',(?:"(?:[^"]|"")*"|[^"\r\n,]*)' END) END AS cells
  FROM judged
), unquoted AS (
  SELECT line_id, well, list_transform(cells, lambda c: CASE WHEN c[2] = '"' THEN replace(c[3:-2], '""', '"') ELSE c[2:] END) AS c
  FROM split
)"""

_P3_CHECKS = r""", fields AS (
  SELECT line_id, c[2] AS date_cell, c[5] AS loc FROM unquoted WHERE well AND len(c) = 9
), dates AS (
  SELECT line_id, regexp_replace(date_cell, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS d FROM fields
), bad_dates AS (
  SELECT line_id FROM dates WHERE d <> '' AND NOT coalesce(
    regexp_full_match(d, '[0-9]{8}|[0-9]{14}') AND
    try_strptime(CASE WHEN length(d) = 8 THEN d || '000000' ELSE d END, '%Y%m%d%H%M%S') IS NOT NULL, FALSE)
), blocks AS (
  SELECT line_id, string_split(unnest(string_split(loc, ';')), '#') AS f FROM fields WHERE trim(loc) <> ''
), positions AS (
  SELECT line_id, f, len(f) AS n, CASE WHEN len(f) = 7 THEN f[5] ELSE f[6] END AS lat, CASE WHEN len(f) = 7 THEN f[6] ELSE f[7] END AS lon
  FROM blocks
), bad_locations AS (
  SELECT DISTINCT line_id FROM positions WHERE NOT coalesce(
    n BETWEEN 7 AND 9 AND regexp_full_match(f[1], '[0-9]+')
    AND regexp_full_match(lat, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') AND regexp_full_match(lon, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')
    AND abs(try_cast(lat AS DOUBLE)) <= 90 AND abs(try_cast(lon AS DOUBLE)) <= 180, FALSE)
), failed AS (
  SELECT line_id, 'quoting' AS reason FROM unquoted WHERE NOT well
  UNION ALL SELECT line_id, 'column_count' FROM unquoted WHERE well AND len(c) <> 9
  UNION ALL SELECT line_id, 'bad_date' FROM bad_dates
  UNION ALL SELECT line_id, 'bad_location' FROM bad_locations
)"""


@REGISTRY.query("p3_found", _P3_PARSED + _P3_CHECKS + " SELECT line_id, reason FROM failed")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return parsing.errors(table(spark, base, "gkg_lines"))


@REGISTRY.query(
    "p3_valid_rows",
    _P3_PARSED
    + _P3_CHECKS
    + """ SELECT line_id, c[1] AS gkgrecordid,
      CASE WHEN trim(c[2]) = '' THEN NULL ELSE strptime(rpad(trim(c[2]), 14, '0'), '%Y%m%d%H%M%S') END AS published_at,
      c[3] AS sourcecommonname, CASE WHEN trim(c[5]) = '' THEN 0 ELSE len(string_split(c[5], ';')) END AS n_locations
    FROM unquoted WHERE line_id NOT IN (SELECT line_id FROM failed)""",
)
def p3_valid_rows(spark: SparkSession, base: str) -> DataFrame:
    valid, _ = parsing.split_rows(table(spark, base, "gkg_lines"))
    return valid.select(
        "line_id", "gkgrecordid", F.col("date").cast("timestamp_ntz").alias("published_at"), "sourcecommonname",
        F.size("v2locations").cast("bigint").alias("n_locations"),
    )


def located_memories(spark: SparkSession, base: str) -> DataFrame:
    """(memory_id, lat, lon) of each memory with a usable location; redelivered rows count once."""
    at = lambda i: F.get("geo_location", F.lit(i))
    return (
        table(spark, base, "remember_requests")
        .select("memory_id", at(0).alias("lat"), at(1).alias("lon"))
        .where(geo.usable(F.col("lat"), F.col("lon")) & F.col("memory_id").isNotNull())
        .dropDuplicates(["memory_id", "lat", "lon"])
    )


def spatial_requests(spark: SparkSession, base: str) -> DataFrame:
    """(request_id, lat, lon, radius) of each recall request whose spatial filter is complete and possible."""
    radius = F.col("geo_radius_meters")
    return (
        table(spark, base, "recall_requests")
        .where(geo.usable(F.col("geo_lat"), F.col("geo_lon")) & ~F.isnan(radius) & (radius > 0))
        .select("request_id", F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon"), radius.alias("radius"))
    )


@REGISTRY.query(
    "p7_found",
    """
WITH m AS (
  SELECT DISTINCT memory_id, geo_location[1] AS lat, geo_location[2] AS lon FROM remember_requests
  WHERE isfinite(geo_location[1]) AND isfinite(geo_location[2])
    AND geo_location[1] BETWEEN -90 AND 90 AND geo_location[2] BETWEEN -180 AND 180
), r AS (
  SELECT request_id, geo_lat AS lat, geo_lon AS lon, geo_radius_meters AS radius FROM recall_requests
  WHERE isfinite(geo_lat) AND isfinite(geo_lon) AND geo_lat BETWEEN -90 AND 90 AND geo_lon BETWEEN -180 AND 180
    AND NOT isnan(geo_radius_meters) AND geo_radius_meters > 0
)
SELECT DISTINCT request_id, memory_id FROM r JOIN m ON abs(r.lat - m.lat) * 111000 <= r.radius + 1
WHERE 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(m.lat - r.lat) / 2), 2)
  + cos(radians(r.lat)) * cos(radians(m.lat)) * pow(sin(radians(m.lon - r.lon) / 2), 2)))) <= r.radius""",
)
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return geo.within_radius(spatial_requests(spark, base), located_memories(spark, base), "request_id", "memory_id").distinct()


#: Corners (latitude, longitude) of the regions asked about; a parameter of the query.
REGIONS = {
    "north_pacific": [(10.0, -160.0), (60.0, -160.0), (60.0, -120.0), (35.0, -140.0), (10.0, -120.0)],
    "equator_east": [(-15.0, 120.0), (30.0, 120.0), (30.0, 179.999), (-15.0, 179.999)],
    "south_triangle": [(-60.0, -10.0), (-30.0, 0.5), (-60.0, 70.0)],
    "south_pacific": [(-20.0, -160.0), (-0.1, -160.0), (8.0, -135.0), (-20.0, -135.0)],
}
_EDGES = ", ".join(
    f"('{name}', {a}, {b}, {c}, {d})"
    for name, p in REGIONS.items()
    for (a, b), (c, d) in zip(p, [*p[1:], *p[:1]], strict=True)
)


@REGISTRY.query(
    "p7_regions",
    f"""
WITH m AS (
  SELECT DISTINCT memory_id, geo_location[1] AS lat, geo_location[2] AS lon FROM remember_requests
  WHERE isfinite(geo_location[1]) AND isfinite(geo_location[2])
    AND geo_location[1] BETWEEN -90 AND 90 AND geo_location[2] BETWEEN -180 AND 180
), edge(region, a, b, c, d) AS (VALUES {_EDGES})
SELECT memory_id, region FROM m, edge
WHERE (a <= lat AND lat < c OR c <= lat AND lat < a) AND b + (lat - a) / (c - a) * (d - b) > lon
GROUP BY memory_id, lat, lon, region HAVING count(*) % 2 = 1""",
)
def p7_regions(spark: SparkSession, base: str) -> DataFrame:
    return geo.in_regions(located_memories(spark, base), REGIONS, "memory_id")
