"""The nearest place of a supplied gazetteer, by cells on the sphere.

Positions become points of the unit sphere, cut into cubes, so that neither the poles nor the date line are special. A point looks
at its own cube and the 26 around it: whatever is nearer than an edge lies in one of them. Points that find nothing so near look
again in cubes of four times the edge, until the cubes hold the whole sphere; so points pay for the emptiness around them only.
Distances are exact great circles. All is equi-joins on the cube; positions are searched once, however many points share them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import asin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.catalog import small, written
from tessera.functions.geo import EARTH_KM, haversine

#: The finest cubes have an edge of 2 ** -FINEST radii (12 km); at edges of 2 radii the neighbours are everything.
FINEST = 9
COARSEST = -1
STEP = 2
_OFFSETS = (-1, 0, 1)


def _xyz(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cube(edge: float, step: tuple[int, int, int] = (0, 0, 0)) -> Column:
    return F.struct(*[(F.floor(F.col(c) / edge) + s).alias(c) for c, s in zip("xyz", step)])


def _valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def nearest_place(points: DataFrame, places: DataFrame, most_km: float | None = None) -> DataFrame:
    """points (with lat, lon) with place_id and distance_km of the nearest of places (place_id, lat, lon); the smaller id of equal ones.

    Positions that are null or out of range have none, nor those farther than most_km from every place. Distances are told
    to a millimetre, and are equal if they are so far.
    """
    columns = points.columns
    at = points.filter(_valid(F.col("lat"), F.col("lon"))).select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon")).distinct()
    left = written(at.select("__lat", "__lon", *[c.alias(n) for c, n in zip(_xyz(F.col("__lat"), F.col("__lon")), "xyz")]), "positions")
    known = places.filter(_valid(F.col("lat"), F.col("lon")) & F.col("place_id").isNotNull()).select("place_id", F.col("lat").cast("double").alias("__plat"), F.col("lon").cast("double").alias("__plon"))
    known = small(written(known.select("*", *[c.alias(n) for c, n in zip(_xyz(F.col("__plat"), F.col("__plon")), "xyz")]), "places"))
    around = [(i, j, k) for i in _OFFSETS for j in _OFFSETS for k in _OFFSETS]
    done = []
    for level in range(FINEST, COARSEST - 1, -STEP):
        edge = 2.0**-level
        # A chord of one edge, as a great circle; a little less, for rounding.
        reach = 2 * EARTH_KM * asin(min(1.0, edge / 2)) * (1 - 1e-9)
        asked = left.withColumn("__cube", F.explode(F.array(*[_cube(edge, s) for s in around])))
        pairs = asked.drop("x", "y", "z").join(known.withColumn("__cube", _cube(edge)).drop("x", "y", "z"), "__cube")
        km = F.round(haversine(F.col("__lat"), F.col("__lon"), F.col("__plat"), F.col("__plon")), 6)
        near = pairs.groupBy("__lat", "__lon").agg(F.min(F.struct(km.alias("km"), "place_id")).alias("b"))
        near = near.select("__lat", "__lon", F.col("b.place_id").alias("place_id"), F.col("b.km").alias("distance_km"))
        found = written(near if level == COARSEST else near.filter(F.col("distance_km") <= reach), "nearest-places")
        done.append(found)
        if level == COARSEST or (most_km is not None and reach >= most_km):
            break
        left = written(left.join(found, ["__lat", "__lon"], "left_anti"), "positions")
        if left.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    found = found if most_km is None else found.filter(F.col("distance_km") <= most_km)
    found = small(written(found, "found-places"))
    return points.join(found, (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), "left").select(*columns, "place_id", "distance_km")


@dataclass(frozen=True)
class Gazetteer:
    """Places (place_id, lat, lon, label, city, admin1, admin2, country) of one source, how near one must be, and how sure it is."""

    source: str
    places: DataFrame
    most_km: float | None = None
    confidence: float = 0.70


def reverse_geocoded(points: DataFrame, gazetteers: list[Gazetteer]) -> DataFrame:
    """points with place: the nearest one of the first gazetteer that has one near enough, as a struct; null without one.

    place: source, place_id, label, city, admin1, admin2, country, distance_km, confidence. A position is only asked of the
    second gazetteer where the first knows nothing, and so on.
    """
    columns = points.columns
    left = written(points.select("lat", "lon").filter(_valid(F.col("lat"), F.col("lon"))).distinct(), "positions")
    done = []
    for g in gazetteers:
        found = nearest_place(left, g.places, g.most_km).filter(F.col("place_id").isNotNull())
        named = found.join(small(written(g.places.drop("lat", "lon"), "gazetteer")), "place_id")
        place = F.struct(F.lit(g.source).alias("source"), F.col("place_id").cast("string").alias("place_id"), "label", "city", "admin1", "admin2", "country", "distance_km", F.lit(g.confidence).alias("confidence"))
        done.append(written(named.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), place.alias("place")), "geocoded"))
        left = written(left.join(done[-1], (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), "left_anti"), "positions")
    known = small(written(reduce(DataFrame.unionByName, done), "geocoded"))
    return points.join(known, (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon")), "left").select(*columns, "place")


def place_prefix(place: Column) -> Column:
    """How a place stands before a caption: city and district together for CN, else `city, admin1`; else its label."""
    said = lambda *cs: F.filter(F.array_distinct(F.array(*cs)), lambda x: x.isNotNull() & (x != ""))
    china = F.slice(said(*[F.when(place["country"] == "CN", place[c]) for c in ("city", "admin2")]), 1, 2)
    other = F.slice(said(place["city"], place["admin1"]), 1, 2)
    return F.when(F.size(china) > 0, F.array_join(china, "")).when(F.size(other) > 0, F.array_join(other, ", ")).otherwise(place["label"])
