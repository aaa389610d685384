"""The nearest place against brute force: poles, date line, empty regions, ties, equal positions; gazetteers in turn."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import places


def km(a, b):
    p, q, r, s = (math.radians(v) for v in (*a, *b))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))


def brute(points, known, most=None):
    out = {}
    for i, lat, lon in points:
        best = (None, None)
        if lat is not None and lon is not None and -90 <= lat <= 90 and -180 <= lon <= 180 and known:
            d, p = min((round(km((lat, lon), (a, b)), 6), p) for p, a, b in known)
            best = (p, d) if most is None or d <= most else best
        out[i] = best
    return out


@pytest.mark.parametrize("seed, n_places, most", [(1, 400, None), (3, 400, 300.0), (4, 0, None)])
def test_same_as_brute_force(spark, seed, n_places, most):
    rng = np.random.default_rng(seed)
    known = [(i, float(rng.normal(40, 3)), float(rng.normal(10, 5))) for i in range(n_places)]
    known += [(9000, 89.99, 10.0), (9001, -90.0, 0.0), (9002, 10.0, 179.99), (9003, 10.0, -179.99)] if n_places > 3 else []
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(60)] + [(100 + i, float(rng.normal(40, 3)), float(rng.normal(10, 5))) for i in range(200)]
    points += [(900, 89.9, -170.0), (901, -89.0, 120.0), (902, 10.0, 180.0), (903, 10.0, -180.0), (904, None, 1.0), (905, 91.0, 0.0), (906, 40.0, 10.0), (907, 40.0, 10.0), (908, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    found = places.nearest_place(df, spark.createDataFrame(known, "place_id int, lat double, lon double"), most)
    got = {r.id: (r.place_id, r.distance_km) for r in found.collect()}
    want = brute(points, known, most)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and (want[i][1] is None or got[i][1] == pytest.approx(want[i][1], abs=2e-6))


def test_equal_distances_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double")
    known = spark.createDataFrame([(7, 0.0, 1.0), (3, 0.0, -1.0), (5, 1.0, 0.0)], "place_id int, lat double, lon double")
    assert places.nearest_place(df, known).first().place_id == 3


def test_gazetteers_in_turn(spark):
    schema = "place_id int, lat double, lon double, label string, city string, admin1 string, admin2 string, country string"
    near = spark.createDataFrame([(1, 22.53, 114.05, "广东省深圳市福田区", "深圳市", "广东省", "福田区", "CN")], schema)
    world = spark.createDataFrame([(1, 35.02, 135.77, "Kyoto, Kyoto Prefecture, JP", "Kyoto", "Kyoto Prefecture", None, "JP"), (2, 22.0, 114.0, "x", "x", None, None, "XX")], schema)
    points = spark.createDataFrame([(1, 22.54, 114.06), (2, 35.0, 135.7), (3, 181.0, 1.0), (4, None, None)], "id int, lat double, lon double")
    found = places.reverse_geocoded(points, [places.Gazetteer("borders", near, 50.0, 0.9), places.Gazetteer("names", world)])
    got = {r.id: r for r in found.withColumn("prefix", places.place_prefix(F.col("place"))).collect()}
    assert (got[1].place.source, got[1].place.confidence, got[1].prefix) == ("borders", 0.9, "深圳市福田区")
    assert (got[2].place.source, got[2].place.confidence, got[2].prefix) == ("names", 0.7, "Kyoto, Kyoto Prefecture")
    assert got[3].place is None and got[4].place is None and got[3].prefix is None
