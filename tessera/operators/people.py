"""What is known of a person: memory, companions, groups, summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def memory(rows: DataFrame, person: str, asset: str, ts: str, place: str, top: int = 8) -> DataFrame:
    """Per person: assets, first and last time, and the most frequent places (by count, then name)."""
    base = rows.groupBy(person).agg(F.countDistinct(asset).alias("assets"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    counts = rows.filter(F.col(place).isNotNull()).groupBy(person, place).agg(F.countDistinct(asset).alias("n"))
    rank = F.row_number().over(W.partitionBy(person).orderBy(F.desc("n"), place))
    best = counts.withColumn("r", rank).filter(F.col("r") <= top).groupBy(person).agg(F.sort_array(F.collect_list(F.struct("r", F.col(place).alias("p")))).alias("t"))
    return base.join(best, person, "left").withColumn("places", F.array_join(F.transform("t", lambda x: x["p"].cast("string")), ",")).drop("t")


def event_memory(participants: DataFrame, event: str, person: str) -> DataFrame:
    """Per person and event the others who took part, in order. An event bounds its participants."""
    members = participants.select(event, person).distinct()
    all_of = members.groupBy(event).agg(F.array_sort(F.collect_set(person)).alias("m"))
    return members.join(all_of, event).withColumn("others", F.array_join(F.transform(F.filter("m", lambda x: x != F.col(person)), lambda x: x.cast("string")), ",")).drop("m")


def keyword_events(rows: DataFrame, text: str, event: str, pattern: str, k: int) -> DataFrame:
    """Words that match a pattern, by the number of distinct events that have them; the k most frequent (a report)."""
    words = rows.select(event, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.countDistinct(event).alias("events")).orderBy(F.desc("events"), "word").limit(k)


def groups(entities: DataFrame, keys: list[str], name: str, weight: str) -> DataFrame:
    """Groups of entities by keys: members, sum and maximum of a weight, and the first member by name."""
    return entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum(weight).alias("total"), F.max(weight).alias("most"), F.min(name).alias("first_member"))


def unpivoted_stats(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric: peak, mean, p50 (index n div 2) and p95 (index trunc(0.95 n)) of its values, exactly.

    Means are of exact sums (to eight digits), so they don't depend on the order of rows.

    One sort by (metric, value) over range partitions; positions come from per-partition counts.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    long = rows.select(pairs.alias("p")).select("p.metric", "p.v").filter("v IS NOT NULL")
    # Equal values collapse before anything is ranked: the window runs over distinct values only.
    counts = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("metric").orderBy("v")
    placed = counts.withColumn("hi", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy("metric")))
    at = lambda i: F.max(F.when((F.col("hi") > i) & (F.col("hi") - F.col("c") <= i), F.col("v")))
    last = F.col("n") - 1
    return placed.groupBy("metric").agg(F.max("n").alias("n"), F.max("v").alias("peak"), (F.sum(F.col("v").cast("decimal(18,8)") * F.col("c").cast("decimal(18,0)")).cast("double") / F.sum("c")).alias("mean"), at(F.least(last, F.floor(F.col("n") / 2))).alias("p50"), at(F.least(last, F.floor(F.col("n") * F.lit(0.95)))).alias("p95"))


def latest_caption(assets: DataFrame, observations: DataFrame, key: str, caption: str, order: list[str]) -> DataFrame:
    """Assets with the caption of their latest observation, null without one."""
    latest = observations.groupBy(key).agg(F.max(F.struct(*order, caption))[caption].alias("latest_caption"))
    return assets.join(latest, key, "left")


def named_relations(edges: DataFrame, entities: DataFrame, key: str, name: str, subject: str, object_: str) -> DataFrame:
    """Relations with the names of both ends."""
    s = entities.select(F.col(key).alias("__s"), F.col(name).alias("subject_name"))
    o = entities.select(F.col(key).alias("__o"), F.col(name).alias("object_name"))
    return edges.join(s, edges[subject] == s["__s"]).join(o, F.col(object_) == o["__o"]).drop("__s", "__o")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
