"""People, summaries, trips and further joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.vector import decay
from tessera.operators import events as event_ops
from tessera.operators import joins, people
from tessera.registry import ORACLES, query

_TS = "yyyy-MM-dd HH:mm:ss"


@query(
    "person_memory",
    """WITH b AS (SELECT user_id, count(DISTINCT event_id) AS assets, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY ALL),
    k AS (SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY user_id, event_type),
    c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM k),
    t AS (SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS places FROM c WHERE r <= 8 GROUP BY user_id)
    SELECT b.*, places FROM b LEFT JOIN t USING (user_id)""",
)
def person_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets, first and last time and most frequent kinds of every user."""
    found = people.memory(catalog.load(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_type")
    return found.withColumn("first_ts", F.date_format("first_ts", _TS)).withColumn("last_ts", F.date_format("last_ts", _TS))


@query("person_event_memory", "WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_orderkey, a.l_suppkey, coalesce(string_agg(b.l_suppkey::VARCHAR, ',' ORDER BY b.l_suppkey), '') AS others FROM p a LEFT JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL")
def person_event_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier and order the other suppliers."""
    return people.event_memory(catalog.participants(spark, sf_dir), "l_orderkey", "l_suppkey")


@query("keyword_event_counts", "SELECT word, count(DISTINCT conv_id) AS events FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]*(?:meal|tion|heit)[a-z]*')) AS word FROM conversations) GROUP BY word ORDER BY events DESC, word LIMIT 20")
def keyword_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty matching words that most conversations have; a conversation counts once."""
    return people.keyword_events(catalog.load(spark, sf_dir, "conversations"), "text", "conv_id", "[a-z]*(?:meal|tion|heit)[a-z]*", 20)


@query("entity_groups", "SELECT p_type, p_size, count(*) AS members, round(sum(p_retailprice), 2) AS total, max(p_retailprice) AS most, min(p_name) AS first_member FROM part GROUP BY ALL")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.groups(catalog.load(spark, sf_dir, "part"), ["p_type", "p_size"], "p_name", "p_retailprice").withColumn("total", F.round("total", 2))


@query(
    "unpivoted_stats",
    """WITH l AS (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM l)
    SELECT metric, max(n) AS n, max(v) AS peak, round(sum(v::DECIMAL(18,2))::DOUBLE / count(*), 9) AS mean, max(CASE WHEN i = n // 2 THEN v END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN v END) AS p95 FROM r GROUP BY metric""",
)
def unpivoted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, mean and two exact percentiles of several metrics."""
    return people.unpivoted_stats(catalog.load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("mean", F.round("mean", 9))


@query("run_summary", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS users, round(avg(o_totalprice), 4) AS mean_price, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 9) AS finished, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.load(spark, sf_dir, "orders")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("users"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.round(people.share(F.col("o_orderstatus") == "F"), 9).alias("finished"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"),
    )


@query("delivery_breakdown", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open_lines, count(*) FILTER (l_linestatus = 'F') AS done_lines FROM lineitem GROUP BY l_returnflag")
def delivery_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind and state, pivoted over the known states."""
    rows = catalog.load(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.count_if(F.col("l_linestatus") == "F").alias("done_lines"))


@query("latest_caption", "SELECT c_custkey, (SELECT arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS latest_caption FROM customer")
def latest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the status of the latest order, null without one."""
    orders = catalog.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return people.latest_caption(catalog.load(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])


@query("named_relations", "SELECT e.a, e.b, s.s_name AS subject_name, o.s_name AS object_name FROM (SELECT DISTINCT l_suppkey AS a, l_suppkey % 7 + 1 AS b FROM lineitem) e JOIN supplier s ON s.s_suppkey = a JOIN supplier o ON o.s_suppkey = b")
def named_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") % 7 + 1).alias("b")).distinct()
    return people.named_relations(edges, catalog.load(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "a", "b")


def _trips(events: DataFrame) -> DataFrame:
    """Trips among events, places made up from their numbers (the tables hold no positions)."""
    spot = F.col("event_id") % 5
    rows = events.select("user_id", "event_id", "ts", F.concat(F.lit("p"), spot.cast("string")).alias("place"), (F.lit(10.0) + spot * 2).alias("lat"), (F.lit(20.0) + spot * 3).alias("lon"))
    found = event_ops.trips(rows, "user_id", "event_id", "ts", "place", "lat", "lon")
    return found.select("user_id", "session_no", "events", "places", F.round("km", 6).alias("km"), F.round("confidence", 6).alias("confidence"))


@query(
    "trips",
    """WITH x AS (SELECT user_id, event_id, ts, 'p' || (event_id % 5)::VARCHAR AS place, 10.0 + event_id % 5 * 2 AS lat, 20.0 + event_id % 5 * 3 AS lon FROM events),
    n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 259200000000 THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM n),
    s AS (SELECT user_id, session_no, min(ts) AS a, max(ts) AS b, count(*) AS events, count(DISTINCT place) AS places FROM g GROUP BY ALL),
    d AS (SELECT DISTINCT user_id, session_no, lat, lon FROM g),
    k AS (SELECT p.user_id, p.session_no, max(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))))) AS km FROM d p JOIN d q ON p.user_id = q.user_id AND p.session_no = q.session_no GROUP BY ALL)
    SELECT s.user_id, s.session_no, events, places, round(km, 6) AS km, round(least(0.9, 0.45 + 0.08 * events + 0.04 * places), 6) AS confidence FROM s JOIN k ON s.user_id = k.user_id AND s.session_no = k.session_no
    WHERE events >= 2 AND date_diff('day', a, b) BETWEEN 1 AND 10 AND places >= 2 AND km >= 50""",
)
def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips among all events."""
    return _trips(catalog.load(spark, sf_dir, "events"))


query("trips_of_all_events", ORACLES["trips"])(trips)


@query(
    "event_pair_scores",
    """SELECT a.event_id AS left_id, b.event_id AS right_id, round(greatest(0, 1 - least(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 6e7, 360) / 360), 6) AS time_score
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'view' AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000""",
)
def event_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time scores of pairs of views of a user that are within six hours: candidates for merging, by slots."""
    rows = catalog.load(spark, sf_dir, "events").filter("event_type = 'view'")
    a = rows.select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("t1"))
    b = rows.select("user_id", F.col("event_id").alias("right_id"), F.col("ts").alias("t2"))
    near = joins.within(a, b, ["user_id"], "t1", "t2", 6 * 3600).filter("left_id < right_id")
    minutes = F.abs(joins.micros("t1") - joins.micros("t2")) / 6e7
    return near.select("left_id", "right_id", F.round(decay(minutes, 360.0), 6).alias("time_score"))


@query("channel_intersection", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def channel_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two sets and not in a third."""
    labels = catalog.load(spark, sf_dir, "labels")
    english = catalog.load(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return english.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("event_sources_union", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT user_id FROM events WHERE event_type = 'error'")
def event_sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct union of ids from three sources."""
    a = catalog.load(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    b = catalog.load(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    c = catalog.load(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id")
    return a.union(b).union(c).distinct()
