"""Names, claims, properties, relations, evidence and their changes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import knowledge as ops
from tessera.registry import query

_TS = "yyyy-MM-dd HH:mm:ss"


def _joined(column: str):
    return F.array_join(column, ",")


@query(
    "person_assets",
    """WITH f AS (SELECT s_nationkey AS person_id, l_orderkey AS asset_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), m AS (SELECT c_nationkey AS person_id, o_orderkey AS asset_id FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT person_id, asset_id, count(DISTINCT path) AS paths FROM (SELECT *, 0 AS path FROM f UNION ALL SELECT *, 1 FROM m) GROUP BY ALL""",
)
def person_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets (orders) in which a person (nation) is by face (a supplier's) or by mention (a customer's)."""
    lines, orders = catalog.load(spark, sf_dir, "lineitem"), catalog.load(spark, sf_dir, "orders")
    faces = lines.join(catalog.load(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("person_id"), F.col("l_orderkey").alias("asset_id"))
    named = orders.join(catalog.load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("person_id"), F.col("o_orderkey").alias("asset_id"))
    return ops.person_assets([faces, named])


@query(
    "person_events",
    """SELECT person_id, event_id, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, row_number() OVER (PARTITION BY person_id ORDER BY start_ts, event_id) AS ordinal
    FROM (SELECT DISTINCT l_suppkey AS person_id, o_custkey AS event_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey) JOIN (SELECT o_custkey AS event_id, min(o_orderdate) AS start_ts FROM orders GROUP BY ALL) USING (event_id)""",
)
def person_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (a customer's orders) of each person (supplier), in order of time."""
    orders = catalog.load(spark, sf_dir, "orders")
    mentions = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("obs_id"))
    bridge = orders.select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("event_id"))
    events = orders.groupBy(F.col("o_custkey").alias("event_id")).agg(F.min("o_orderdate").alias("start_ts"))
    return ops.person_events(mentions, bridge, events).select("person_id", "event_id", F.date_format("start_ts", _TS).alias("start_ts"), "ordinal")


@query(
    "resolved_names",
    """WITH p AS (SELECT p_size AS scope_id, p_partkey AS person_id, p_name AS name, [p_brand, p_type] AS aliases FROM part), q AS (SELECT DISTINCT p_size AS scope_id, name FROM part, unnest([p_name, p_brand || ' ', 'nobody']) AS t(name)),
    n AS (SELECT scope_id, name AS n, person_id, 0 AS via FROM p UNION ALL SELECT scope_id, unnest(aliases), person_id, 1 FROM p), b AS (SELECT scope_id, n, min((via, person_id)) AS b FROM n GROUP BY ALL)
    SELECT q.scope_id, q.name, b.b[2]::BIGINT AS person_id, b.b[1] = 1 AS via_alias FROM q LEFT JOIN b ON q.scope_id = b.scope_id AND trim(q.name) = b.n""",
)
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (of parts), aliases (their brands) and unknown ones, resolved within a scope (size)."""
    rows = catalog.load(spark, sf_dir, "part")
    people = rows.select(F.col("p_size").alias("scope_id"), F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"))
    asked = rows.select(F.col("p_size").alias("scope_id"), F.explode(F.array("p_name", F.concat("p_brand", F.lit(" ")), F.lit("nobody"))).alias("name")).distinct()
    return ops.resolved_names(asked, people)


@query("entity_type_order", "SELECT o_orderkey, p AS type_place, row_number() OVER (PARTITION BY p ORDER BY o_totalprice, o_orderkey) AS ordinal FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS p FROM orders)")
def entity_type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a given order of their priorities."""
    return ops.ordered_by_type(catalog.load(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW", "2-HIGH"], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "type_place", "ordinal")


@query(
    "claim_states",
    """WITH l AS (SELECT user_id AS person_id, CASE WHEN event_id % 2 = 0 THEN 'place' ELSE 'role' END AS dimension, CASE WHEN event_id % 3 = 0 THEN '参加' ELSE '参与' END AS p, trim(event_type) AS value, event_id % 10 AS ev, event_id, value AS confidence FROM events),
    c AS (SELECT person_id, dimension, '参与' AS predicate, value, min(event_id) AS "at", max(confidence) AS confidence, count(DISTINCT event_id) AS evidence, count(DISTINCT ev) AS support FROM l GROUP BY person_id, dimension, value),
    f AS (SELECT *, first(value) OVER (PARTITION BY person_id, dimension ORDER BY "at") AS fv FROM c)
    SELECT person_id, dimension, predicate, value, confidence, evidence, support, CASE WHEN dimension = 'role' AND value <> fv THEN fv END AS supersedes, CASE WHEN dimension = 'role' AND value <> fv THEN 'pending' ELSE 'active' END AS status, CASE WHEN dimension = 'role' AND value <> fv THEN 2 ELSE 1 END AS revision FROM f""",
)
def claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that the event log leaves: synonymous predicates merged, several places at a time, one role."""
    k = F.col("event_id")
    log = catalog.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), F.when(k % 2 == 0, "place").otherwise("role").alias("dimension"), F.when(k % 3 == 0, "参加").otherwise("参与").alias("predicate"), F.col("event_type").alias("value"),
        (k % 10).alias("event_id"), k.alias("evidence_id"), F.col("value").alias("confidence"), k.alias("at"),
    )
    found = ops.claims(log)
    return found.select("person_id", "dimension", "predicate", "value", "confidence", F.size("evidence").cast("long").alias("evidence"), F.col("support").cast("long").alias("support"), "supersedes", "status", "revision")


@query(
    "property_states",
    """WITH l AS (SELECT user_id AS entity_id, event_type AS key, event_id AS "at", CASE WHEN value > 60 THEN 'user' ELSE 'derived' END AS source, 'v' || event_id % 3 AS value, value AS confidence FROM events),
    u AS (SELECT *, sum(CASE WHEN source = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, key ORDER BY "at" ROWS UNBOUNDED PRECEDING)::BIGINT AS users FROM l),
    k AS (SELECT *, first(value) OVER (PARTITION BY entity_id, key ORDER BY "at") AS fv FROM u WHERE source = 'user' OR users = 0),
    g AS (SELECT *, CASE WHEN source = 'derived' AND value = fv THEN -1 ELSE "at" END AS version FROM k),
    v AS (SELECT entity_id, key, version, min("at") AS "at", any_value(value) AS value, any_value(source) AS source, max(confidence) AS confidence, count(*) AS evidence, max(users) AS users FROM g GROUP BY ALL),
    s AS (SELECT *, max(users) OVER w AS last, max(CASE WHEN source = 'derived' THEN 1 ELSE 0 END) OVER w AS d FROM v WINDOW w AS (PARTITION BY entity_id, key))
    SELECT entity_id, key, value, source, confidence, evidence, "at", CASE WHEN source = 'user' AND users = last THEN 'active' WHEN last > 0 THEN 'superseded' WHEN version = -1 THEN 'active' ELSE 'pending' END AS status,
      CASE WHEN source = 'user' THEN users + d WHEN version = -1 THEN 1 ELSE 2 END::INTEGER AS revision FROM s""",
)
def property_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of properties, of which high values count as the user's own."""
    k = F.col("event_id")
    log = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("key"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("value"), F.when(F.col("value") > 60, "user").otherwise("derived").alias("source"), F.col("value").alias("confidence"), k.alias("evidence_id"), k.alias("at"))
    return ops.properties(log).withColumn("evidence", F.size("evidence").cast("long"))


@query("property_values", "SELECT user_id AS entity_id, event_type AS key, string_agg(v, ',' ORDER BY \"at\") AS values FROM (SELECT user_id, event_type, 'v' || event_id % 4 AS v, min(event_id) AS \"at\" FROM events GROUP BY ALL) GROUP BY ALL")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of properties that hold several, in order."""
    log = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("key"), F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("value"), F.col("event_id").alias("at"))
    return ops.merged_values(log).withColumn("values", _joined("values"))


@query(
    "relation_states",
    """WITH l AS (SELECT user_id AS subject, 'knows' AS predicate, event_id % 7 AS object, CASE WHEN event_type = 'error' THEN 'retract' WHEN event_type = 'purchase' THEN 'confirm' ELSE 'assert' END AS action, value AS confidence, event_id AS "at" FROM events),
    s AS (SELECT subject, predicate, object, arg_max(action, "at") AS last, arg_max(action, "at") FILTER (action <> 'assert') AS verdict, max(confidence) AS confidence, count(*) AS evidence FROM l GROUP BY ALL)
    SELECT subject, predicate, object, confidence, evidence, CASE WHEN verdict IS NULL THEN 'candidate' WHEN verdict = 'retract' AND last = 'assert' THEN 'candidate' WHEN verdict = 'retract' THEN 'retracted' ELSE 'confirmed' END AS status FROM s""",
)
def relation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after assertions, confirmations and retractions."""
    kind = F.col("event_type")
    log = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.lit("knows").alias("predicate"), (F.col("event_id") % 7).alias("object"), F.when(kind == "error", "retract").when(kind == "purchase", "confirm").otherwise("assert").alias("action"), F.col("value").alias("confidence"), F.col("event_id").alias("evidence_id"), F.col("event_id").alias("at"))
    return ops.relations(log).withColumn("evidence", F.size("evidence").cast("long"))


@query("rehomed_labels", "SELECT user_id AS scope_id, CASE event_type WHEN 'view' THEN 'looked' WHEN 'click' THEN 'looked' ELSE 'bought' END AS target, event_id % 20 AS obs_id, max(value) AS confidence FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL")
def rehomed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of legacy labels, moved to the entities of a vocabulary; labels outside it are retired."""
    rows = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("scope_id"), F.col("event_type").alias("name"), (F.col("event_id") % 20).alias("obs_id"), F.col("value").alias("confidence"))
    return ops.rehomed(rows.select("scope_id", "name").distinct(), rows, {"view": "looked", "click": "looked", "purchase": "bought"}, ("looked", "bought"))[1]


@query("entity_evidence", "SELECT l_suppkey AS entity_id, count(DISTINCT o_orderkey) AS observations, count(DISTINCT o_custkey) AS assets, count(DISTINCT o_custkey % 10) AS events, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_ts, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def entity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shows each supplier: orders, customers, and the latest of them."""
    mentions = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("obs_id"))
    seen = catalog.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("asset_id"), (F.col("o_custkey") % 10).alias("event_id"), F.col("o_orderdate").alias("ts"))
    found = ops.entity_evidence(mentions, seen)
    return found.withColumn("first_ts", F.date_format("first_ts", _TS)).withColumn("last_ts", F.date_format("last_ts", _TS))


@query("renamed_entities", "WITH l AS (SELECT user_id, event_type, min(event_id) AS \"at\", max(event_id) AS last FROM events GROUP BY ALL) SELECT user_id AS entity_id, arg_max(event_type, last) AS name, coalesce(string_agg(event_type, ',' ORDER BY \"at\") FILTER (last < m), '') AS aliases FROM (SELECT *, max(last) OVER (PARTITION BY user_id) AS m FROM l) GROUP BY ALL")
def renamed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each entity's names, the earlier ones as aliases."""
    log = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("name"), F.col("event_id").alias("at"))
    return ops.renamed(log).withColumn("aliases", _joined("aliases"))


@query(
    "appearance_evidence",
    """WITH l AS (SELECT user_id AS person_id, event_id % 5 AS face_id, event_type AS model, 'c' || event_id % 3 AS clothing, value AS confidence, event_id AS "at" FROM events WHERE user_id % 2 = 0 AND event_id % 5 < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY person_id, face_id, model ORDER BY "at" DESC) AS n FROM l)
    SELECT person_id, face_id, model, clothing, confidence, "at", row_number() OVER (PARTITION BY person_id ORDER BY confidence DESC, "at" DESC, face_id, model) AS rank FROM r WHERE n = 1""",
)
def appearance_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last appearance of confirmed persons' own faces, by confidence."""
    k = F.col("event_id")
    log = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), (k % 5).alias("face_id"), F.col("event_type").alias("model"), F.array(F.concat(F.lit(" c"), (k % 3).cast("string")), F.lit("")).alias("clothing"), F.col("value").alias("confidence"), k.alias("at"))
    found = ops.appearance_evidence(log, log.filter("face_id < 3"), log.filter("person_id % 2 = 0").select("person_id").distinct())
    return found.withColumn("clothing", _joined("clothing"))


@query("gap_states", "WITH f AS (SELECT user_id AS gap_id, arg_max(coalesce(CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'a' || event_id END, 'confirmed'), event_id) AS resolution FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT c_custkey AS gap_id, resolution, CASE WHEN resolution IS NULL THEN 'open' ELSE 'resolved' END AS status FROM customer LEFT JOIN f ON gap_id = c_custkey")
def gap_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps (customers) with what the last feedback (an error) made of them."""
    k = F.col("event_id")
    feedback = catalog.load(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("gap_id"), F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("correction"), F.when(k % 3 == 1, F.concat(F.lit("a"), k.cast("string"))).alias("accepted"), k.alias("at"))
    return ops.gap_states(catalog.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gap_id")), feedback)


@query("dialogue_states", "SELECT user_id AS conversation_id, json_extract_string(arg_max(props, event_id), '$.k') AS k, NULL::VARCHAR AS secret FROM events GROUP BY ALL")
def dialogue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each conversation (user), allowed keys only."""
    log = catalog.load(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.col("props").alias("state"), F.col("event_id").alias("at"))
    return ops.dialogue_states(log, ("k", "secret"))


@query("profile_texts", "SELECT user_id, string_agg(event_type, '、' ORDER BY r) AS profile FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id), event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r <= 3 GROUP BY ALL")
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most common kinds of each user's events as a text."""
    return ops.profile_text(catalog.load(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("matched_topics", "WITH w AS (SELECT DISTINCT CASE WHEN conv_id % 4 = 0 THEN 'obs:' || turn ELSE conv_id::VARCHAR END AS event, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS topic FROM conversations WHERE regexp_matches(text, '[Dd]as|[Tt]he')) SELECT topic, count(*) AS events FROM w GROUP BY topic ORDER BY events DESC, topic LIMIT 20")
def matched_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty words that most conversations share among messages that match (a top-k report)."""
    rows = catalog.load(spark, sf_dir, "conversations").select(F.col("turn").alias("obs_id"), F.when(F.col("conv_id") % 4 != 0, F.col("conv_id")).alias("event_id"), "text")
    return ops.matched_topics(rows, "[Dd]as|[Tt]he", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))


@query(
    "person_summaries",
    """WITH r AS (SELECT l_suppkey AS person_id, l_linenumber + l_orderkey * 10 AS asset_id, l_orderkey AS event_id, l_shipdate AS ts, l_returnflag AS place FROM lineitem),
    b AS (SELECT person_id, count(DISTINCT asset_id) AS assets, count(DISTINCT event_id) AS events, strftime(min(ts), '%Y-%m-%d') AS first_ts, strftime(max(ts), '%Y-%m-%d') AS last_ts FROM r GROUP BY ALL),
    p AS (SELECT person_id, string_agg(place, ',' ORDER BY n) AS places FROM (SELECT person_id, place, row_number() OVER (PARTITION BY person_id ORDER BY count(DISTINCT asset_id) DESC, place) AS n FROM r GROUP BY person_id, place) WHERE n <= 8 GROUP BY ALL),
    m AS (SELECT DISTINCT event_id, person_id FROM r), c AS (SELECT a.person_id, b.person_id AS other, row_number() OVER (PARTITION BY a.person_id ORDER BY count(*) DESC, b.person_id) AS n FROM m a JOIN m b ON a.event_id = b.event_id AND a.person_id <> b.person_id GROUP BY a.person_id, b.person_id),
    t AS (SELECT person_id, string_agg(other::VARCHAR, ',' ORDER BY n) AS companions FROM c WHERE n <= 10 GROUP BY ALL)
    SELECT b.*, places, companions FROM b LEFT JOIN p USING (person_id) LEFT JOIN t USING (person_id)""",
)
def person_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about each supplier in one row."""
    rows = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person_id"), (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("asset_id"), F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("place"))
    found = ops.person_summary(rows, rows.select("event_id", "person_id"))
    return found.withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd")).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd"))


@query("grouped_members", "SELECT s_nationkey, count(*) AS members, round(sum(s_suppkey), 2)::DOUBLE AS total, max(s_acctbal) AS confidence, string_agg(s_name, ',' ORDER BY s_suppkey DESC, s_name) AS names FROM supplier GROUP BY ALL")
def grouped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation with their names in order of weight."""
    found = ops.groups_with_members(catalog.load(spark, sf_dir, "supplier"), ["s_nationkey"], "s_name", "s_suppkey", "s_acctbal")
    return found.withColumn("total", F.round(F.col("total"), 2).cast("double"))


@query("merged_objects", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS x, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS tags, 2 AS canon FROM events")
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects merged, the later winning; JSON arrays read with a fallback; repeats by canonical form dropped."""
    k = F.col("event_id")
    rows = catalog.load(spark, sf_dir, "events").withColumn("m", ops.merge_objects(F.concat(F.lit('{"x": "old", '), F.substring("props", 2, 1000)), F.when(k % 2 == 0, F.lit('{"x": "new"}')).otherwise(F.lit("broken"))))
    tags = ops.json_list(F.when(k % 3 == 0, F.lit("no list")).otherwise(F.lit('["a", "b"]')))
    canon = ops.canonical_distinct(F.array(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b":"2","a":"1"}'), F.lit('{"a": "2"}')))
    return rows.select("event_id", F.col("m")["k"].cast("bigint").alias("k"), F.col("m")["x"].alias("x"), F.size(tags).alias("tags"), F.size(canon).alias("canon"))


@query("allowed_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def allowed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of customers that a tool may show."""
    return ops.allowed_columns(catalog.load(spark, sf_dir, "customer"), {"segments": ("c_custkey", "c_mktsegment", "c_secret")}, "segments")


@query("semantic_group_keys", "SELECT CASE WHEN p_size = 7 THEN 'seven' WHEN lower(trim(p_brand)) = 'brand#1' THEN 'first' WHEN contains(lower(p_brand), '#2') THEN 'two' WHEN p_type = 'ECONOMY' THEN 'cheap' ELSE lower(trim(p_brand)) END AS key, count(*) AS n FROM part GROUP BY ALL")
def semantic_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the key under which their brands are grouped."""
    key = ops.group_keys(F.col("p_brand"), F.when(F.col("p_size") == 7, "seven"), {"brand#1": "first"}, {"#2": "two"}, F.when(F.col("p_type") == "ECONOMY", "cheap"))
    return catalog.load(spark, sf_dir, "part").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
