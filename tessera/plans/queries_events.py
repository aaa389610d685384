"""Events: candidates, online assignment, consolidation, re-segmentation, summaries. Observations are made of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.vector import cosine
from tessera.operators import events as ops
from tessera.operators import joins
from tessera.registry import query

#: The event log as observations, in SQL; observations() makes the same rows.
_OBS = """o AS (SELECT event_id AS obs_id, user_id AS scope_id, ts, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'p' || event_id % 5 END AS location, 'v' || event_id % 3 AS visual_place, event_type AS kind,
  CASE event_id % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'Walk the dog' WHEN 2 THEN 'cook' ELSE 'cook dinner' END AS activity, ['o' || event_id % 4, 'o' || event_id % 7] AS objects, ['u' || event_id % 6] AS people,
  CASE WHEN event_id % 2 = 0 THEN 10 + event_id % 5 * 0.005 END AS lat, CASE WHEN event_id % 2 = 0 THEN 20 + event_id % 7 * 0.004 END AS lon,
  CASE WHEN event_id % 3 <> 0 THEN [event_id % 5 - 2.0, event_id % 7 - 3.0, 1.0]::DOUBLE[] END AS vector, user_id * 1000 + epoch_us(ts) // 43200000000 % 1000 AS event_id FROM events)"""
_KM = "(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"
_SCORE = f"""CASE WHEN NOT overlap_objects AND NOT overlap_people AND activity <> other_activity AND NOT list_contains(kinds, kind) AND coalesce(alike, 1) < 0.45 THEN 0 ELSE
  least(1, 0.25 * t + 0.25 * l + CASE WHEN list_contains(places, visual_place) THEN 0.15 ELSE 0 END + CASE WHEN list_contains(kinds, kind) THEN 0.05 * 0.8 ELSE 0 END
  + CASE WHEN contains(activity, other_activity) OR contains(other_activity, activity) THEN 0.20 * 0.9 ELSE 0 END + CASE WHEN overlap_objects THEN 0.05 * 0.8 ELSE 0 END + CASE WHEN overlap_people THEN 0.20 * 0.8 ELSE 0 END
  + 0.05 * least(1, greatest(0, (coalesce(alike, 0) - 0.7) / 0.3)) + CASE WHEN t >= 0.9 AND l >= 0.9 THEN 0.2 ELSE 0 END) END"""
#: Profiles of events in SQL, and the score of pairs (obs_id, event_id) of a table p.
_PROFILES = """e AS (SELECT event_id, scope_id, min(ts) AS start_ts, lower(arg_min(activity, (ts, obs_id))) AS other_activity, list(DISTINCT nullif(location, '')) AS locations, list(DISTINCT visual_place) AS places, list(DISTINCT kind) AS kinds,
  list_distinct(flatten(list(objects))) AS objects, list_distinct(flatten(list(people))) AS people FROM m GROUP BY ALL)"""


def _scored(pairs: str) -> str:
    return f"""near AS (SELECT p.obs_id, p.event_id, max(greatest(0, 1 - {_KM.format(a="x", b="y")} / 2)) AS l FROM {pairs} p JOIN o x ON x.obs_id = p.obs_id JOIN m y ON y.event_id = p.event_id WHERE x.lat IS NOT NULL AND y.lat IS NOT NULL GROUP BY ALL),
like_ AS (SELECT p.obs_id, p.event_id, max(list_cosine_similarity(x.vector, y.vector)) AS alike FROM {pairs} p JOIN o x ON x.obs_id = p.obs_id JOIN m y ON y.event_id = p.event_id WHERE x.vector IS NOT NULL AND y.vector IS NOT NULL GROUP BY ALL),
wide AS (SELECT p.obs_id, p.event_id, e.start_ts, lower(o.activity) AS activity, other_activity, o.kind, kinds, places, visual_place, alike,
  greatest(0, 1 - abs(epoch_us(o.ts) - epoch_us(e.start_ts)) / 6e7 / 360) AS t, CASE WHEN o.lat IS NOT NULL THEN coalesce(near.l, 0) WHEN o.location <> '' AND list_contains(locations, o.location) THEN 1.0 ELSE 0 END AS l,
  list_has_any(o.objects, e.objects) AS overlap_objects, list_has_any(o.people, e.people) AS overlap_people
  FROM {pairs} p JOIN o ON o.obs_id = p.obs_id JOIN e ON e.event_id = p.event_id LEFT JOIN near ON near.obs_id = p.obs_id AND near.event_id = p.event_id LEFT JOIN like_ ON like_.obs_id = p.obs_id AND like_.event_id = p.event_id),
scored AS (SELECT obs_id, event_id, start_ts, round({_SCORE}, 9) AS score FROM wide)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as observations, grouped into events of half a day."""
    return of_events(catalog.load(spark, sf_dir, "events"))


def of_events(log: DataFrame) -> DataFrame:
    """Rows of the event log, or of a stream of it, as observations."""
    k = F.col("event_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    gps = F.struct((F.lit(10.0) + k % 5 * 0.005).alias("lat"), (F.lit(20.0) + k % 7 * 0.004).alias("lon"))
    activity = F.element_at(F.array(*[F.lit(a) for a in ("walk", "Walk the dog", "cook", "cook dinner")]), (k % 4 + 1).cast("int"))
    return log.select(
        k.alias("obs_id"), F.col("user_id").alias("scope_id"), "ts", F.when(k % 4 == 0, "").otherwise(text("p", 5)).alias("location"), text("v", 3).alias("visual_place"), F.col("event_type").alias("kind"), activity.alias("activity"),
        F.array(text("o", 4), text("o", 7)).alias("objects"), F.array(text("u", 6)).alias("people"), F.when(k % 2 == 0, gps).alias("gps"),
        F.when(k % 3 != 0, F.array(k % 5 - 2.0, k % 7 - 3.0, F.lit(1.0))).alias("vector"), (F.col("user_id") * 1000 + F.floor(joins.micros("ts") / 43_200_000_000) % 1000).alias("event_id"),
    )


@query(
    "event_candidates",
    f"""WITH {_OBS}, m AS (SELECT * FROM o WHERE kind = 'purchase'), {_PROFILES}, a AS (SELECT obs_id, scope_id, ts FROM o WHERE kind <> 'purchase'),
    p AS (SELECT a.obs_id, e.event_id FROM a JOIN e ON a.scope_id = e.scope_id AND abs(epoch_us(a.ts) - epoch_us(e.start_ts)) <= 21600000000), {_scored("p")}
    SELECT obs_id, event_id, score FROM scored""",
)
def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every observation that is no purchase for the events of purchases within six hours."""
    rows = observations(spark, sf_dir)
    profiles = ops.event_profiles(rows.filter("kind = 'purchase'"))
    return ops.candidates(rows.filter("kind <> 'purchase'").drop("event_id"), profiles).select("obs_id", "event_id", F.round("score", 9).alias("score"))


@query(
    "event_choices",
    f"""WITH {_OBS}, m AS (SELECT * FROM o WHERE kind = 'purchase'), {_PROFILES}, a AS (SELECT obs_id, scope_id, ts FROM o WHERE kind <> 'purchase'),
    p AS (SELECT a.obs_id, e.event_id FROM a JOIN e ON a.scope_id = e.scope_id AND abs(epoch_us(a.ts) - epoch_us(e.start_ts)) <= 21600000000), {_scored("p")}
    SELECT obs_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, start_ts, event_id) AS r FROM scored WHERE score >= 0.5) WHERE r = 1""",
)
def event_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that each of those observations would join."""
    rows = observations(spark, sf_dir)
    profiles = ops.event_profiles(rows.filter("kind = 'purchase'"))
    return ops.best_candidates(ops.candidates(rows.filter("kind <> 'purchase'").drop("event_id"), profiles))


@query(
    "event_resegmentation",
    f"""WITH {_OBS}, m AS (SELECT * FROM o), {_PROFILES}, s AS (SELECT event_id, scope_id, min(obs_id) AS obs_id FROM o WHERE list_contains(people, 'u1') GROUP BY ALL), st AS (SELECT event_id, min(ts) AS start_ts FROM o GROUP BY ALL),
    p AS (SELECT b.obs_id, a.event_id, b.event_id AS other FROM s a JOIN s b ON a.scope_id = b.scope_id AND a.event_id <> b.event_id JOIN st x ON x.event_id = a.event_id JOIN st y ON y.event_id = b.event_id WHERE abs(epoch_us(x.start_ts) - epoch_us(y.start_ts)) <= 21600000000), {_scored("p")}
    SELECT scored.event_id, min(p.other) AS other FROM scored JOIN p ON p.obs_id = scored.obs_id AND p.event_id = scored.event_id WHERE score >= 0.5 GROUP BY ALL""",
)
def event_resegmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a newly confirmed person bridges."""
    return ops.resegmented(observations(spark, sf_dir), "u1")


@query(
    "event_visual_similarity",
    f"WITH {_OBS} SELECT a.obs_id, b.event_id, round(max(list_cosine_similarity(a.vector, b.vector)), 9) AS similarity FROM o a JOIN o b ON a.scope_id = b.scope_id AND a.kind = 'click' AND b.kind = 'view' AND a.event_id = b.event_id AND a.vector IS NOT NULL AND b.vector IS NOT NULL GROUP BY ALL",
)
def event_visual_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each click the likeness to the most alike view of its event: vectors joined by event, then the maximum."""
    rows = observations(spark, sf_dir).filter("vector IS NOT NULL").select("obs_id", "scope_id", "event_id", "kind", "vector")
    a = rows.filter("kind = 'click'").select("obs_id", "scope_id", "event_id", "vector")
    b = rows.filter("kind = 'view'").select("scope_id", "event_id", F.col("vector").alias("other"))
    return a.join(b, ["scope_id", "event_id"]).groupBy("obs_id", "event_id").agg(F.round(F.max(cosine(F.col("vector"), F.col("other"))), 9).alias("similarity"))


@query(
    "event_pair_merges",
    f"""WITH {_OBS}, v AS (SELECT * FROM o WHERE kind = 'view'),
    p AS (SELECT a.obs_id AS left_id, b.obs_id AS right_id, greatest(0, 1 - least(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 6e7, 360) / 360) AS t, coalesce(greatest(0, 1 - {_KM.format(a="a", b="b")}), 0) AS l, coalesce(list_cosine_similarity(a.vector, b.vector), 0) AS s,
      CASE WHEN list_has_any(a.w, b.w) THEN 1.0 WHEN len(list_filter(a.w, lambda x: len(list_filter(b.w, lambda y: length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x)))) > 0)) > 0 THEN 0.7 ELSE 0 END AS w, list_has_any(a.people, b.people) AS f
      FROM (SELECT *, list_append(objects, activity) AS w FROM v) a JOIN (SELECT *, list_append(objects, activity) AS w FROM v) b ON a.scope_id = b.scope_id AND a.obs_id < b.obs_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 6480000000)
    SELECT left_id, right_id, round(0.35 * t + 0.25 * l + 0.25 * s + 0.1 * w + CASE WHEN f THEN 0.05 ELSE 0 END, 9) AS total,
      t >= 0.7 AND ((l >= 0.65 AND (s >= 0.55 OR w > 0 OR f)) OR (s >= 0.8 AND (w > 0 OR f)) OR (l >= 0.85 AND w > 0)) AS merge FROM p""",
)
def event_pair_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and merge rule of all pairs of a user's views (as events of one observation) that are near enough in time."""
    rows = observations(spark, sf_dir).filter("kind = 'view'").withColumn("w", F.array_append("objects", F.col("activity")))
    side = lambda s: rows.select("scope_id", F.col("obs_id").alias(f"{s}_id"), F.col("ts").alias(f"{s}_ts"), F.col("gps").alias(f"{s}_gps"), F.col("vector").alias(f"{s}_v"), F.col("w").alias(f"{s}_w"), F.col("people").alias(f"{s}_f"))
    near = joins.within(side("left"), side("right"), ["scope_id"], "left_ts", "right_ts", ops.MERGE_GAP_S).filter("left_id < right_id")
    minutes = F.abs(joins.micros("left_ts") - joins.micros("right_ts")) / 6e7
    metres = ops.haversine(F.col("left_gps.lat"), F.col("left_gps.lon"), F.col("right_gps.lat"), F.col("right_gps.lon")) * 1000
    total, merge = ops.pair_score(minutes, metres, cosine(F.col("left_v"), F.col("right_v")), ops.semantic_overlap(F.col("left_w"), F.col("right_w")), F.arrays_overlap("left_f", "right_f"))
    return near.select("left_id", "right_id", F.round(total, 9).alias("total"), merge.alias("merge"))


@query(
    "event_summaries",
    f"""WITH {_OBS}, ev AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '某处' WHEN 1 THEN '12.5, 30.1' WHEN 2 THEN NULL ELSE 'garden' END AS place, 'a' || event_id % 3 AS activity, CASE WHEN event_id % 5 = 0 THEN 'north' ELSE '' END AS prefix FROM (SELECT DISTINCT event_id FROM o)),
    sh AS (SELECT event_id, arg_min(location, (ts, obs_id)) AS shown FROM o WHERE location <> '' GROUP BY ALL),
    n AS (SELECT event_id, string_agg(name, '、' ORDER BY seq, name) AS who FROM (SELECT event_id, people[1] AS name, min(obs_id) AS seq FROM o WHERE obs_id % 3 = 0 GROUP BY ALL) GROUP BY ALL),
    b AS (SELECT ev.event_id, CASE WHEN place = 'garden' THEN place ELSE coalesce(shown, place, 'OTHER') END AS pl, activity, prefix, who FROM ev LEFT JOIN sh USING (event_id) LEFT JOIN n USING (event_id)),
    t AS (SELECT *, CASE WHEN who IS NOT NULL THEN who || '在' || pl || '参与' || activity ELSE '在' || pl || '发生的' || activity END AS body FROM b)
    SELECT event_id, pl AS place, CASE WHEN prefix <> '' AND NOT contains(body, '在' || prefix) THEN '在' || prefix || '，' || body ELSE body END AS summary FROM t""",
)
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place that says something and a sentence for every event of half a day."""
    rows = observations(spark, sf_dir)
    e = F.col("event_id")
    place = F.when(e % 4 == 0, "某处").when(e % 4 == 1, "12.5, 30.1").when(e % 4 == 3, "garden")
    events = rows.select("event_id").distinct().select("event_id", place.alias("place"), F.concat(F.lit("a"), (e % 3).cast("string")).alias("activity"), F.when(e % 5 == 0, "north").otherwise("").alias("prefix"))
    names = rows.filter("obs_id % 3 = 0").select("event_id", F.col("obs_id").alias("seq"), F.col("people")[0].alias("name"))
    return ops.event_summaries(events, rows.select("event_id", "ts", "obs_id", F.col("location").alias("place")), names)


@query("event_assignment")
def event_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online assignment in order of arrival, by user; tests/test_models.py holds it against a plain model."""
    return ops.assigned(observations(spark, sf_dir))


@query("event_consolidation")
def event_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event of half a day each one ends in; tests/test_models.py holds it against a plain model."""
    return ops.consolidated(observations(spark, sf_dir))
