"""Geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DEGREE_KM = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(a)) * (2 * EARTH_KM)


def half_box(lat: Column, radius_km: float) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle."""
    return F.lit(radius_km / DEGREE_KM), F.lit(radius_km) / (F.cos(F.radians(lat)) * DEGREE_KM + 1e-9)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; areas are not clamped."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = wide * high
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (area(a) + area(b) - inter + 1e-8)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """v over its length, which is taken once and not for every component; a zero vector as it is."""
    v = F.col(v) if isinstance(v, str) else v
    held = F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n")))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x))), F.lit(0))


def pixel_to_latlon(x1, y1, x2, y2, lat_min, lat_max, lon_min, lon_max, tile: int = 640) -> tuple[Column, Column]:
    """The box centre in degrees: rows count from the north edge down."""
    cx, cy = (x1 + x2) / 2.0 / tile, (y1 + y2) / 2.0 / tile
    return F.round(lat_max - cy * (lat_max - lat_min), 6), F.round(lon_min + cx * (lon_max - lon_min), 6)
