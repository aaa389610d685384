"""Places on the globe as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth.
EARTH_KM = 6371.0088


def parse_latlon(text: Column) -> Column:
    """struct<lat, lon> of `lat,lon`; null if it isn't two numbers in range, or is (0, 0)."""
    parts = F.split(F.coalesce(text, F.lit("")), ",", 2)
    lat, lon = F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance, in the radius's unit."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def from_dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)
