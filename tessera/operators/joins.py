"""Joins by time: ranges, overlaps and nearest records, as equi-joins on time slots.

A join on an inequality alone would compare all pairs; slots as wide as the reach make it an equi-join that shuffles and
spills like any other, with the exact condition behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: float, how: str = "inner") -> DataFrame:
    """Pairs with equal keys whose times are at most so many seconds apart. how: inner or left_semi."""
    reach = int(seconds * 1_000_000)
    slot = lambda ts: F.floor(micros(ts) / max(reach, 1))
    a = left.withColumn("__slot", slot(left_ts))
    b = right.withColumn("__slot", F.explode(F.array(*[slot(right_ts) + d for d in (-1, 0, 1)])))
    near = F.abs(micros(a[left_ts]) - micros(b[right_ts])) <= reach
    on = [a[k] == b[k] for k in keys]
    joined = a.join(b, [a["__slot"] == b["__slot"], *on, near], how)
    if how == "left_semi":
        return joined.drop("__slot")
    return joined.drop(a["__slot"]).drop(b["__slot"]).drop(*[b[k] for k in keys])


#: Slots that an interval is spread over at most; longer ones go to slots so many times as wide, again and again.
MOST_SLOTS = 64


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, slot_seconds: float, levels: int = 8) -> DataFrame:
    """Pairs of closed intervals with equal keys that overlap, each once.

    An interval lies in the slots of the first level (each MOST_SLOTS times as wide as the one before) at which it covers
    MOST_SLOTS at most, and it is looked up in its slots of all coarser levels and of its own. So the two meet at the coarser
    one of their levels, in the first slot that they share there, however long they are.
    """
    width = int(slot_seconds * 1_000_000)
    widths = [min(width * MOST_SLOTS**i, 1 << 61) for i in range(levels)]
    slot = lambda ts, w: F.floor(micros(ts) / w)

    def level(s: str, e: str) -> Column:
        out = F.lit(levels - 1)
        for i in reversed(range(levels - 1)):
            out = F.when(slot(e, widths[i]) - slot(s, widths[i]) < MOST_SLOTS, i).otherwise(out)
        return out

    def spread(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        at = F.flatten(F.array(*[F.when(F.lit(i) >= F.col("__level"), F.transform(F.sequence(slot(s, w), slot(e, w)), lambda x: F.struct(F.lit(i).alias("level"), x.alias("slot")))).otherwise(F.array().cast("array<struct<level:int,slot:bigint>>")) for i, w in enumerate(widths)]))
        return df.filter(F.col(s).isNotNull() & (F.col(e) >= F.col(s))).withColumn("__level", level(s, e)).withColumn("__at", F.explode(at)).withColumnRenamed("__level", name)

    a, b = spread(left, l_start, l_end, "__la"), spread(right, r_start, r_end, "__lb")
    coarser = F.greatest("__la", "__lb")
    w = F.element_at(F.array(*[F.lit(x) for x in widths]), (coarser + 1).cast("int"))
    first = F.greatest(F.floor(micros(a[l_start]) / w), F.floor(micros(b[r_start]) / w))
    on = [a[k] == b[k] for k in keys] + [a["__at"] == b["__at"], a[l_end] >= b[r_start], a[l_start] <= b[r_end], a["__at.level"] == coarser, a["__at.slot"] == first]
    return a.join(b, on).drop(a["__at"]).drop(b["__at"]).drop("__la", "__lb").drop(*[b[k] for k in keys])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, right_id: str, value: str, slot_seconds: float = 86_400.0) -> DataFrame:
    """left with the value, id and distance (microseconds) of the right record nearest in time, before or after.

    Ties go to the earlier record, then to the smaller id. No pairs are formed: within a time slot both sides are merged into
    one order and records carried along; what lies outside a slot is one record before it and one after it, from a window over
    the slots of a key, of which there are few however many rows the key has.
    """
    record = F.struct(F.col("__t"), F.col(right_id).alias("id"), F.col(value).alias("value"))
    kind = f"struct<__t:bigint,id:{_kind(right, right_id)},value:{_kind(right, value)}>"
    slot = F.floor(F.col("__t") / int(slot_seconds * 1_000_000)).alias("__slot")
    a = left.withColumn("__t", micros(left_ts)).withColumn("__slot", slot)
    b = right.select(*keys, micros(right_ts).alias("__t"), right_id, value).withColumn("__record", record).select(*keys, "__t", "__record").withColumn("__slot", slot)
    # Of each slot its first record and its last one, the smaller id of equal times.
    late = F.struct((-F.col("__t")).alias("n"), F.col("__record").alias("r"))
    ends = b.groupBy(*keys, "__slot").agg(F.min("__record").alias("first"), F.min(late)["r"].alias("last"))
    slots = a.select(*keys, "__slot").distinct().join(ends, [*keys, "__slot"], "full_outer")
    w = W.partitionBy(*keys).orderBy("__slot")
    slots = slots.withColumn("__before", F.last("last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("__after", F.first("first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    merged = a.withColumn("__record", F.lit(None).cast(kind)).withColumn("__left", F.lit(1)).unionByName(b.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    # Records come before left rows of the same time in the first order, and after them in the second: both see them.
    inside = W.partitionBy(*keys, "__slot")
    before = inside.orderBy("__t", "__left", F.desc("__record")).rowsBetween(W.unboundedPreceding, 0)
    after = inside.orderBy(F.desc("__t"), "__left", F.desc("__record")).rowsBetween(W.unboundedPreceding, 0)
    seen = merged.withColumn("__b", F.last("__record", ignorenulls=True).over(before)).withColumn("__a", F.last("__record", ignorenulls=True).over(after)).filter("__left = 1")
    seen = seen.join(slots.select(*keys, "__slot", "__before", "__after"), [*keys, "__slot"], "left").withColumn("__b", F.coalesce("__b", "__before")).withColumn("__a", F.coalesce("__a", "__after"))
    away = lambda r: F.struct(F.abs(F.col(f"{r}.__t") - F.col("__t")).alias("d"), F.col(f"{r}.__t").alias("t"), F.col(f"{r}.id").alias("id"), F.col(f"{r}.value").alias("value"))
    best = F.array_min(F.filter(F.array(F.when(F.col("__b").isNotNull(), away("__b")), F.when(F.col("__a").isNotNull(), away("__a"))), lambda x: x.isNotNull()))
    kept = seen.withColumn("__n", best)
    return kept.select(*left.columns, F.col("__n.id").alias("nearest_id"), F.col("__n.value").alias("nearest_value"), F.col("__n.d").alias("distance_us"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
