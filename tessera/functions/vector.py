"""Vectors, boxes and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector becomes empty."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.array().cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def rrf(rank: Column, weight: Column | float = 1.0, k: int = 60) -> Column:
    """A channel's weighted reciprocal rank."""
    return (F.lit(weight) if isinstance(weight, float) else weight) / (rank + k)


def decay(distance: Column, limit: float) -> Column:
    """1 at 0, falling to 0 at the limit."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(distance, F.lit(limit)) / limit)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes struct<x1, y1, x2, y2>."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    both = area(a) + area(b) - w * h
    return F.when(both > 0, w * h / both).otherwise(F.lit(0.0))


def centre(box: Column) -> Column:
    """The centre of a box, as struct<x, y>."""
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def centre_distance(a: Column, b: Column, shift: tuple[float, float] = (0.0, 0.0)) -> Column:
    """How far the centres of two boxes of a unit picture are apart, as a share of its diagonal; b is taken back by a shift of the camera."""
    p, q = centre(a), centre(b)
    x, y = p["x"] - (q["x"] - shift[0]), p["y"] - (q["y"] - shift[1])
    return F.sqrt(x * x + y * y) / F.sqrt(F.lit(2.0))


def within_expanded(point: Column, box: Column, by: float = 0.08) -> Column:
    """Whether a point struct<x, y> lies in a box that is widened on each side."""
    return point["x"].between(box["x1"] - by, box["x2"] + by) & point["y"].between(box["y1"] - by, box["y2"] + by)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def set_overlap(a: Column, b: Column) -> Column:
    """1 if the sets meet, 0.7 if a member holds another (both of two characters or more), else 0."""
    held = F.exists(a, lambda x: F.exists(b, lambda y: (F.length(x) >= 2) & (F.length(y) >= 2) & (F.contains(x, y) | F.contains(y, x))))
    return F.when(F.arrays_overlap(a, b), 1.0).when(held, 0.7).otherwise(0.0)


def quality(detection: Column, size: Column, sharpness: Column, frontal: Column) -> Column:
    """Face quality: 0.4, 0.2, 0.2 and 0.2 of the four, each clamped to 0..1."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return clamp(detection) * 0.4 + clamp(size) * 0.2 + clamp(sharpness) * 0.2 + clamp(frontal) * 0.2


def pose_bucket(yaw: Column) -> Column:
    return F.when(yaw.isNull(), "unknown").when(yaw > 20, "left").when(yaw < -20, "right").otherwise("frontal")
