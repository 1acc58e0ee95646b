"""The scalar functions for spark.sql(): temporary SQL functions, whose bodies the optimizer puts in their callers' place."""

from __future__ import annotations

from pyspark.sql import SparkSession

from passwatch.functions.geo import DEGREE_KM, EARTH_KM

#: Name and parameters, type, and body of each.
FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": (
        "DOUBLE",
        f"asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) * {2 * EARTH_KM}D",
    ),
    "near_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, radius_km DOUBLE)": (
        "BOOLEAN",
        f"lat2 BETWEEN lat1 - radius_km / {DEGREE_KM}D AND lat1 + radius_km / {DEGREE_KM}D AND lon2 BETWEEN lon1 - radius_km / (cos(radians(lat1)) * {DEGREE_KM}D + 1e-9D) AND lon1 + radius_km / (cos(radians(lat1)) * {DEGREE_KM}D + 1e-9D)"
        f" AND asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) * {2 * EARTH_KM}D <= radius_km",
    ),
    "box_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE)": (
        "DOUBLE",
        "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)) / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)"
        " - greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)) + 1e-8D)",
    ),
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "l2_norm(a ARRAY<DOUBLE>)": ("DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "alert_level(n BIGINT, max_conf DOUBLE, in_zone BOOLEAN, cloud DOUBLE, history INT)": (
        "STRING",
        "CASE WHEN n = 0 AND cloud > 0.4 AND history > 0 THEN 'YELLOW' WHEN n = 0 THEN 'GREEN' WHEN n >= 3 OR coalesce(max_conf, 0D) >= 0.85 AND coalesce(in_zone, false) OR history >= 3 THEN 'RED'"
        " WHEN coalesce(max_conf, 0D) >= 0.70 OR coalesce(in_zone, false) AND coalesce(max_conf, 0D) >= 0.60 OR cloud > 0.4 AND history > 0 THEN 'ORANGE' WHEN coalesce(max_conf, 0D) >= 0.40 THEN 'YELLOW' ELSE 'GREEN' END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, in place of those of the same names, and return the names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
