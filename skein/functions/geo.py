"""Geographic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.0


def is_valid(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def parse_point(text: Column) -> Column:
    """STRUCT<lat, lon> of a JSON text: {"lat","lon"|"lng"}, {"latitude","longitude"}, [lon, lat], or "lat,lon"; null if none or out of range."""
    get = lambda p: F.get_json_object(text, p).try_cast("double")
    is_object, is_array = text.rlike(r"^\s*\{"), text.rlike(r"^\s*\[")
    pair = F.split(F.regexp_replace(text, r'^\s*"|"\s*$', ""), ",")
    lat = F.when(is_object, F.coalesce(get("$.lat"), get("$.latitude"))).when(is_array, get("$[1]")).when(F.size(pair) == 2, F.trim(F.get(pair, F.lit(0))).try_cast("double"))
    lon = F.when(is_object, F.coalesce(get("$.lon"), get("$.lng"), get("$.longitude"))).when(is_array, get("$[0]")).when(F.size(pair) == 2, F.trim(F.get(pair, F.lit(1))).try_cast("double"))
    return F.when(is_valid(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    """Haversine within km, behind a latitude band that reaches the scan."""
    band = km / KM_PER_DEGREE + 1e-6
    return lat.between(lat0 - band, lat0 + band) & (haversine_km(F.lit(lat0), F.lit(lon0), lat, lon) <= km)


def within_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Inside a box; left > right crosses the antimeridian."""
    across = (lon >= left) | (lon <= right) if left > right else lon.between(left, right)
    return lat.between(bottom, top) & across
