"""Exact order statistics. Conventions differ only in the index of the sorted values, so each is one function of n and q."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(n: Column, q: float) -> Column:
    """Index (from 1) ceil(n q), at least 1."""
    return F.greatest(F.lit(1), F.ceil(n * q).cast("long"))


def rounded_index(n: Column, q: float) -> Column:
    """Index round((n - 1) q), half to even, from 0; here from 1."""
    return (F.bround((n - 1) * F.lit(q), 0) + 1).cast("long")


def truncated_index(n: Column, q: float) -> Column:
    """Index int(n q) from 0, at most the last; here from 1."""
    return F.least(n, F.floor(n * F.lit(q)) + 1).cast("long")


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[Callable[[Column, float], Column], float]]) -> DataFrame:
    """Per key the named order statistics of value (nulls left out).

    Equal values collapse to counts first, map-side, so a key's window runs over its distinct values only.
    """
    w = W.partitionBy(*keys)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = counts.withColumn("__n", F.sum("__c").over(w)).withColumn("__hi", F.sum("__c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    at = lambda r: (F.col("__hi") >= r) & (F.col("__hi") - F.col("__c") < r)
    return placed.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.max(F.when(at(f(F.col("__n"), q)), F.col(value))).alias(name) for name, (f, q) in wanted.items()])


def with_robust_units(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with unit_<column>: each column between its key's 5th and 95th percentiles (interpolated), clipped to 0..1; 0 where it is constant.

    The percentiles come from one aggregate by key, which merges counts map-side, and are joined back.
    """
    stats = [s for c in columns for s in (F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(f"__p_{c}"), F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}"))]
    out = rows.join(rows.groupBy(*keys).agg(*stats), keys, "left")
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    units = []
    for c in columns:
        v, low, high, least, most = F.col(c), F.col(f"__p_{c}")[0], F.col(f"__p_{c}")[1], F.col(f"__a_{c}"), F.col(f"__b_{c}")
        units.append(F.when(high > low, clip((v - low) / (high - low))).when(most > least, clip((v - least) / (most - least))).otherwise(F.lit(0.0)).alias(f"unit_{c}"))
    return out.select(*rows.columns, *units)


def even_indices(n: int, k: int) -> list[int]:
    """k indices spread evenly over n, ends included; rounding half to even."""
    if k >= n:
        return list(range(n))
    if k <= 1:
        return [0][:k]
    out = []
    for i in range(k):
        exact = i * (n - 1) / (k - 1)
        low = math.floor(exact)
        out.append(low + (exact - low > 0.5 or (exact - low == 0.5 and low % 2 == 1)))
    return out
