"""Entities, participants, facts and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import entities, lifecycle, places
from tessera.registry import query


@query(
    "cooccurrence_confidence",
    """WITH p AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS s FROM lineitem)
       SELECT x.s AS a, y.s AS b, count(*) AS shared, round(least(0.9, 0.45 + 0.1 * count(*)), 6) AS confidence FROM p x JOIN p y ON x.e = y.e AND x.s < y.s GROUP BY ALL""",
)
def cooccurrence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.cooccurrence(catalog.participants(spark, sf_dir), "l_orderkey", "l_suppkey")
    return found.withColumn("confidence", F.round("confidence", 6))


@query(
    "companion_topk",
    """WITH p AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS s FROM lineitem)
       SELECT s AS l_suppkey, count(*) AS shared FROM p WHERE s <> 1 AND e IN (SELECT e FROM p WHERE s = 1) GROUP BY s ORDER BY shared DESC, s LIMIT 10""",
)
def companion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten suppliers that share most orders with supplier 1."""
    return entities.companions(catalog.participants(spark, sf_dir), "l_orderkey", "l_suppkey", 1, 10)


@query("person_patterns", "SELECT user_id, 'activity' AS kind, lower(trim(event_type)) AS pattern_value, count(DISTINCT event_id) AS support, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, max(value) AS confidence FROM events GROUP BY ALL")
def person_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.load(spark, sf_dir, "events").withColumn("kind", F.lit("activity"))
    found = entities.patterns(rows, "user_id", "kind", "event_type", "event_id", "ts", "value")
    return found.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


_FACTS = """f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY ALL), a AS (SELECT e.user_id, event_id, event_type, value, ts, first, e.event_type = (SELECT event_type FROM events x WHERE x.event_id = first) AS own FROM events e JOIN f USING (user_id)),
    m AS (SELECT *, CASE WHEN own THEN first ELSE event_id END AS fact_id FROM a)"""


@query(
    "fact_versions",
    f"""WITH {_FACTS} SELECT user_id, fact_id, max(event_type) AS value, CASE WHEN own THEN 1 ELSE 2 END::BIGINT AS revision, CASE WHEN own THEN 'active' ELSE 'pending' END AS status, CASE WHEN NOT own THEN first END AS supersedes, max(value) AS confidence,
    array_to_string(list(event_id ORDER BY ts, event_id), ',') AS evidence FROM m GROUP BY user_id, fact_id, own, first""",
)
def fact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users were seen doing as facts: the first stays active and gathers evidence, every other is pending until confirmed."""
    found = entities.fact_versions(catalog.load(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "ts", "value")
    return found.select("user_id", "fact_id", "value", "revision", "status", "supersedes", "confidence", F.array_join("evidence_ids", ",").alias("evidence"))


@query("fact_confirmations")
def fact_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every purchase confirmed a day after it was seen; tests/test_facts.py has a plain model."""
    events = catalog.load(spark, sf_dir, "events")
    confirmed = events.filter("event_type = 'purchase'").select("event_id", F.expr("ts + INTERVAL 1 DAY").alias("ts"))
    return entities.fact_versions(events, ["user_id"], "event_type", "event_id", "ts", "value", confirmed)


@query("facts_without_subject", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def facts_without_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.without_subject(catalog.load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", catalog.load(spark, sf_dir, "orders"), "o_custkey")


@query("entities_find_or_create", "SELECT source, lang, count(*) AS mentions, max(n_chars) AS confidence, 'entity_' || substr(sha256(source || '|' || lang), 1, 12) AS entity_id FROM documents GROUP BY ALL")
def entities_find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.find_or_create(catalog.load(spark, sf_dir, "documents").select("source", "lang", "n_chars"), ["source", "lang"], "n_chars")


@query("merge_candidates", "SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS keep FROM part GROUP BY ALL HAVING count(*) >= 2")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = catalog.load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return entities.merge_candidates(parts, "p_brand", "p_partkey", "p_type")


@query(
    "entity_remap",
    """WITH m AS (SELECT s_suppkey AS source, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS target FROM supplier),
       p AS (SELECT DISTINCT l_suppkey AS a, l_suppkey % 7 + 1 AS b FROM lineitem)
       SELECT DISTINCT coalesce(x.target, a) AS a, coalesce(y.target, b) AS b FROM p LEFT JOIN m x ON x.source = a LEFT JOIN m y ON y.source = b WHERE coalesce(x.target, a) <> coalesce(y.target, b)""",
)
def entity_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after suppliers of a nation were merged into the first of them."""
    from pyspark.sql import Window as W

    merges = catalog.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.min("s_suppkey").over(W.partitionBy("s_nationkey")).alias("target"))
    edges = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") % 7 + 1).alias("b")).distinct()
    return entities.remapped(edges, merges, ["a", "b"])


@query("access_priority", "SELECT user_id, count(*) AS accesses, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS conversations, count(*) >= 3 AND count(DISTINCT strftime(ts, '%Y-%m-%d')) >= 2 AS priority FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL")
def access_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = catalog.load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return entities.access_priority(log, "user_id", "ts", "day", F.lit("2024-02-04 00:00:00").cast("timestamp_ntz"), 30)


@query("stale_items", "SELECT o.o_orderkey, coalesce(o.o_custkey % 3 < r.m, false) AS stale FROM orders o LEFT JOIN (SELECT c_custkey, c_nationkey % 3 AS m FROM customer) r ON r.c_custkey = o.o_custkey")
def stale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items made from an older revision of their source."""
    items = catalog.load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"), (F.col("o_custkey") % 3).alias("revision"))
    sources = catalog.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_nationkey") % 3).alias("revision"))
    return lifecycle.invalidated(items, sources, "source_id").select("o_orderkey", "stale")


@query("latest_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state per key of old and new rows."""
    events = catalog.load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return entities.upserted(events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are left when finished orders are deleted."""
    gone = catalog.load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    lines = catalog.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lifecycle.cascade({"lineitem": (lines, "l_orderkey")}, gone, "o_orderkey")["lineitem"]


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier merged into the next smaller one of its nation; in region 1 the smallest into the largest, which closes a circle."""
    from pyspark.sql import Window as W

    rows = catalog.load(spark, sf_dir, "supplier").join(F.broadcast(catalog.load(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    w = W.partitionBy("s_nationkey")
    before = F.lag("s_suppkey").over(w.orderBy("s_suppkey"))
    target = F.coalesce(before, F.when(F.col("n_regionkey") == 1, F.max("s_suppkey").over(w)))
    return rows.select(F.col("s_suppkey").alias("source"), target.alias("target")).filter("target IS NOT NULL")


_ROOTS = "r AS (SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root FROM supplier)"


@query("merge_chains", f"WITH {_ROOTS} SELECT l_orderkey AS event_id, root AS entity_id, max(l_discount) AS confidence, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS evidence FROM lineitem JOIN r ON id = l_suppkey GROUP BY ALL")
def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of orders after chains and circles of merges: highest confidence and all evidence at what they have become."""
    edges = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_discount").alias("confidence"), F.array("l_linenumber").alias("evidence"))
    found = entities.remapped(edges, _chains(spark, sf_dir), ["entity_id"], "confidence", "evidence")
    return found.select("event_id", "entity_id", "confidence", F.array_join("evidence", ",").alias("evidence"))


def _merged_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of a customer as events, each merged into the customer's one before it if that is at most 60 days older."""
    from pyspark.sql import Window as W

    orders = catalog.load(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    near = F.datediff("o_orderdate", F.lag("o_orderdate").over(w)) <= 60
    merges = orders.select(F.col("o_orderkey").alias("source"), F.when(near, F.lag("o_orderkey").over(w)).alias("target")).filter("target IS NOT NULL")
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("start_ts"), F.col("o_orderdate").alias("end_ts"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("place"), F.col("o_orderpriority").alias("activity"), F.col("o_totalprice").alias("confidence"), F.lit(1).alias("revision"))
    lines = catalog.load(spark, sf_dir, "lineitem").withColumn("obs_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return entities.merged_events(events, lines.select(F.col("l_orderkey").alias("event_id"), "obs_id"), lines.select("obs_id", F.col("l_suppkey").alias("person_id"), F.col("l_discount").alias("confidence")), merges)


_MERGED = """o AS (SELECT *, CASE WHEN o_orderdate::DATE - lag(o_orderdate::DATE) OVER w <= 60 THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM o),
    h AS (SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey, run ORDER BY o_orderdate, o_orderkey) AS home, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS place FROM s)"""


@query("merged_events", f"WITH {_MERGED} SELECT home AS event_id, min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts, arg_min(place, (o_orderkey <> home, o_orderkey)) FILTER (place IS NOT NULL) AS place, arg_min(o_orderpriority, (o_orderkey <> home, o_orderkey)) AS activity, max(o_totalprice) AS confidence, count(*) AS revision FROM h GROUP BY home")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after chains of merges."""
    return _merged_orders(spark, sf_dir)[0]


@query("merged_participants", f"WITH {_MERGED}, p AS (SELECT home AS event_id, l_suppkey AS person_id, max(l_discount) AS confidence, list_sort(list(DISTINCT l_orderkey * 10 + l_linenumber)) AS e FROM h JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT event_id, person_id, confidence, array_to_string(e, ',') AS evidence FROM p")
def merged_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their participants, rebuilt from the observations that have moved there."""
    return _merged_orders(spark, sf_dir)[2].select("event_id", "person_id", "confidence", F.array_join("evidence_ids", ",").alias("evidence"))


@query(
    "nearest_places",
    """WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1801) / 10 - 90 AS lat, (c_custkey * 911 % 3601) / 10 - 180 AS lon FROM customer), g AS (SELECT s_suppkey AS place_id, (s_suppkey * 53 % 1801) / 10 - 90 AS b, (s_suppkey * 1217 % 3601) / 10 - 180 AS l FROM supplier),
    d AS (SELECT id, place_id, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b)) * pow(sin(radians(l - lon) / 2), 2)))), 6) AS km FROM p, g)
    SELECT id, arg_min(place_id, (km, place_id)) AS place_id, round(min(km), 3) AS km FROM d GROUP BY id""",
)
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place (suppliers, made into a gazetteer) of every customer's position."""
    at = lambda key, a, b: ((key * a % 1801 / 10 - 90).alias("lat"), (key * b % 3601 / 10 - 180).alias("lon"))
    points = catalog.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *at(F.col("c_custkey"), 37, 911))
    known = catalog.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), *at(F.col("s_suppkey"), 53, 1217))
    return places.nearest_place(points, known).select("id", "place_id", F.round("distance_km", 3).alias("km"))
