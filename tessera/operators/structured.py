"""The structured executor: a QuerySpec over assets (and observations, entity mentions) as one lazy plan.

Role columns of assets: asset_id, ts, media_type, scope_id, and optionally place, city. A null time passes no time filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains, strip_admin_suffix
from tessera.plans.spec import QuerySpec

UNKNOWN = "unknown"


def place_matches(value: str, label: Column, parts: list[Column], aliases: Column | None = None) -> Column:
    """The value lies in the label, or an administrative part (without its ending) in the value, or an alias in the label."""
    hit = contains(label, F.lit(value))
    for part in parts:
        short = strip_admin_suffix(part)
        hit = hit | F.coalesce((F.length(short) >= 2) & F.contains(F.lit(value), short), F.lit(False))
    if aliases is not None:
        hit = hit | F.coalesce(F.exists(aliases, lambda a: F.contains(F.lower(label), F.lower(a))), F.lit(False))
    return hit


def filtered(assets: DataFrame, spec: QuerySpec, mentions: DataFrame | None = None) -> DataFrame:
    """Assets that pass the filters of a spec. Entities are any-of: a semi-join on mentions (asset_id, entity_id)."""
    out = assets
    if spec.scope_id:
        out = out.filter(F.col("scope_id") == spec.scope_id)
    if spec.media:
        out = out.filter(F.col("media_type").isin(*spec.media))
    if spec.not_media:
        out = out.filter(~F.col("media_type").isin(*spec.not_media))
    if spec.start is not None:
        out = out.filter(F.col("ts") >= F.lit(spec.start).cast(assets.schema["ts"].dataType))
    if spec.end is not None:
        out = out.filter(F.col("ts") < F.lit(spec.end).cast(assets.schema["ts"].dataType))
    if spec.place:
        out = out.filter(place_matches(spec.place, F.col("place"), [F.col("city")] if "city" in assets.columns else []))
    if spec.entity_ids and mentions is not None:
        out = out.join(mentions.filter(F.col("entity_id").isin(*spec.entity_ids)), "asset_id", "left_semi")
    return out


def group_key(group_by: str, columns: list[str]) -> Column:
    if group_by == "place":
        blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) if c in columns else F.lit(None).cast("string")
        gps = F.when(F.col("location").isNotNull(), F.lit("has location")) if "location" in columns else F.lit(None).cast("string")
        return F.coalesce(blank("city"), blank("place"), gps, F.lit(UNKNOWN))
    if group_by == "media":
        return F.col("media_type")
    return F.date_format("ts", {"year": "yyyy", "date": "yyyy-MM-dd"}.get(group_by, "yyyy-MM"))


def execute(assets: DataFrame, spec: QuerySpec, mentions: DataFrame | None = None) -> DataFrame:
    """The answer's rows; how they look depends on the operation."""
    rows, op = filtered(assets, spec, mentions), spec.operation
    if op == "count":
        return rows.agg(F.countDistinct("asset_id").alias("n"))
    if op == "exists":
        return rows.select("asset_id").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
    if op in ("first", "last", "date"):
        return rows.agg((F.max if op == "last" else F.min)("ts").alias("ts"))
    if op == "date_range":
        return rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("asset_id").alias("n"))
    if op == "list":
        latest = F.max_by("caption", F.struct("ts", "asset_id")) if "caption" in assets.columns else F.lit(None).cast("string")
        return rows.groupBy("asset_id").agg(F.max("ts").alias("ts"), latest.alias("caption"))
    key = group_key(spec.group_by, assets.columns)
    grouped = rows.withColumn("g", key).filter(F.col("g").isNotNull())
    if op == "distinct":
        return grouped.select("g").distinct()
    return grouped.groupBy("g").agg(F.countDistinct("asset_id").alias("n"))


def coverage(groups: DataFrame) -> DataFrame:
    """Of place groups (g, n): how many assets have a known place, how many none, and all."""
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("g") != UNKNOWN, F.col("n"))), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("g") == UNKNOWN, F.col("n"))), F.lit(0)).alias("unknown"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def hierarchy(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by outer and inner place; a null place is the unknown bucket, flagged so that it can be listed last."""
    named = rows.select(F.coalesce(outer, F.lit(UNKNOWN)).alias("outer_place"), F.coalesce(inner, F.lit(UNKNOWN)).alias("inner_place"))
    counts = named.groupBy("outer_place", "inner_place").agg(F.count(F.lit(1)).alias("n"))
    outer_n = counts.groupBy("outer_place").agg(F.sum("n").alias("outer_n"))
    return counts.join(outer_n, "outer_place").withColumn("last", (F.col("outer_place") == UNKNOWN).cast("int"))


def place_filter(value: str, fields: list[Column], aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The value, or an alias of it, lies in one of the fields, or a field's name without its ending lies in the value."""
    hit = F.lit(False)
    for name in (value, *(aliases or {}).get(value, ())):
        for f in fields:
            short = strip_admin_suffix(f)
            hit = hit | contains(f, F.lit(name)) | F.coalesce((F.length(short) >= 2) & F.contains(F.lit(name), short), F.lit(False))
    return hit


def grouped_with_observations(assets: DataFrame, observations: DataFrame, key: Column) -> DataFrame:
    """g and n: assets by a key of theirs and of their observations (a left join); an asset counts once in each of its groups."""
    return assets.join(observations, "asset_id", "left").groupBy(key.alias("g")).agg(F.countDistinct("asset_id").alias("n")).filter("g IS NOT NULL")
