"""Scans, lookups, clusters' operations, lifecycle and streams, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import clusters, entities, joins, lifecycle, online, retrieval, review, scans, sequences, structured
from tessera.plans import queries_events
from tessera.registry import query
from tessera.streaming import expiry
from tessera.streaming import sessions as streams

_TS = "yyyy-MM-dd HH:mm:ss"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.load(spark, sf_dir, "events")


# --- scans -----------------------------------------------------------------------------------------------------------


@query("scan_observations", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id LIMIT 100")
def scan_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred observations of a scope (a top-k report), their JSON decoded."""
    newest = scans.newest(_events(spark, sf_dir), "ts", "event_id", 100, F.col("user_id") == 3)
    return scans.decoded(newest, {"props": "struct<k:bigint>"}).select("event_id", F.col("props.k").alias("k"))


@query("scan_events", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest active events of a scope (a top-k report)."""
    return scans.newest(catalog.load(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 200, (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("point_lookups", "SELECT kind, id, found FROM (SELECT 'asset' AS kind, l_orderkey * 3 AS id, EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey * 3) AS found FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT 'event', l_orderkey * 2, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey * 2) FROM (SELECT DISTINCT l_orderkey FROM lineitem))")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two kinds looked up at once."""
    keys = catalog.load(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    wanted = keys.select(F.lit("asset").alias("kind"), (F.col("l_orderkey") * 3).alias("id")).unionAll(keys.select(F.lit("event"), F.col("l_orderkey") * 2))
    return scans.looked_up(wanted, {"asset": (_events(spark, sf_dir), "event_id"), "event": (catalog.load(spark, sf_dir, "orders"), "o_orderkey")}, "kind", "id").select("kind", "id", "found")


_TABLES = ("events", "documents", "conversations", "embeddings", "labels", "customer", "orders", "part", "supplier")


@query(
    "dashboard",
    " UNION ALL ".join(f"SELECT '{t}' AS name, 0 AS position, count(*)::VARCHAR AS value FROM {t}" for t in _TABLES)
    + " UNION ALL SELECT 'newest_events', row_number() OVER (ORDER BY ts DESC, event_id), event_id::VARCHAR FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 8) UNION ALL SELECT 'newest_orders', row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey), o_orderkey::VARCHAR FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8)",
)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine counts and two lists of the newest eight."""
    tables = {t: catalog.load(spark, sf_dir, t) for t in _TABLES}
    return scans.dashboard(tables, {"newest_events": (tables["events"], "ts", "event_id"), "newest_orders": (tables["orders"], "o_orderdate", "o_orderkey")})


@query("table_counts", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'pages', count(*) FROM pages")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tables by their names, which a list allows."""
    return scans.counters({t: catalog.load(spark, sf_dir, t) for t in ("nation", "pages") if t in scans.ALLOWED_TABLES})


@query("faceted_search", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND contains(lower(text), 'the')")
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of chosen facets that contain a word."""
    return scans.faceted(catalog.load(spark, sf_dir, "documents"), {"lang": ("en", "de"), "source": ()}, "text", "The").select("doc_id")


@query("quality_gates", "SELECT vec_id, (vec_id * 37 % 101) / 100 AS quality FROM embeddings WHERE (vec_id * 37 % 101) / 100 >= 0.30")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that reach the least quality."""
    return catalog.load(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 37 % 101 / 100).alias("quality")).filter(F.col("quality") >= 0.30)


@query("batch_assets", "SELECT DISTINCT o_custkey AS event_id, l_orderkey AS asset_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def batch_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and assets of a batch: bridge, observations and assets joined, each pair once."""
    lines = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"))
    bridge = catalog.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("event_id"))
    return lines.join(bridge, "asset_id").select("event_id", "asset_id").distinct()


@query("asset_observations", "SELECT l_orderkey, count(*) AS rows, count(o_orderkey) AS seen FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey GROUP BY ALL")
def asset_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with their observations, those without any too."""
    seen = catalog.load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seen"))
    rows = catalog.load(spark, sf_dir, "lineitem").join(seen, F.col("l_orderkey") == F.col("seen"), "left")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count("seen").alias("seen"))


@query("album_siblings", "WITH s AS (SELECT * FROM events WHERE event_id < 20) SELECT event_id AS asset_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) AS n FROM events WHERE event_id % 97 IN (SELECT event_id % 97 FROM s) AND event_id NOT IN (SELECT event_id FROM s)) WHERE n <= 2")
def album_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two more assets of each album that the first twenty assets are in."""
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("asset_id"), (F.col("event_id") % 97).alias("album"))
    return retrieval.siblings(rows, rows.filter("asset_id < 20"), "album", 2, [F.asc("asset_id")])


@query("geo_groups", "WITH p AS (SELECT c_custkey, coalesce(r_name, 'unknown') AS o, coalesce(n_name, 'unknown') AS i FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal >= 0 LEFT JOIN region ON r_regionkey = n_regionkey) SELECT o AS outer_place, i AS inner_place, count(DISTINCT c_custkey) AS assets, count(o_orderkey) AS observations FROM p LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def geo_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in two levels with their assets (customers) and observations (orders)."""
    seen = catalog.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), "o_orderkey")
    unknown = lambda c: F.coalesce(c, F.lit(structured.UNKNOWN))
    rows = catalog.places(spark, sf_dir).join(seen, "asset_id", "left")
    return rows.groupBy(unknown("place").alias("outer_place"), unknown("city").alias("inner_place")).agg(F.countDistinct("asset_id").alias("assets"), F.count("o_orderkey").alias("observations"))


@query("chosen_covers", "SELECT user_id, arg_max(event_id, (CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END, value, ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id")
def chosen_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's cover among what is no error, a user's own choice first."""
    return sequences.cover(_events(spark, sf_dir), ["user_id"], "ts", "event_id", "value", F.col("event_type") != "error", F.col("event_id") % 50 == 0).select("user_id", "event_id")


# --- clusters --------------------------------------------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as samples of three scopes and two models that arrive by id; every tenth is a prototype of a known cluster."""
    from tessera.functions.vector import l2_normalised

    k = F.col("vec_id")
    view = F.element_at(F.array(F.lit("frontal"), F.lit("left"), F.lit("right"), F.lit("unknown")), (k % 4 + 1).cast("int"))
    rows = catalog.load(spark, sf_dir, "embeddings").select("vec_id", l2_normalised(F.col("embedding")).alias("vector"), (k % 3).alias("scope_id"), view.alias("view"), (k * 37 % 101 / 100).alias("quality"))
    samples = rows.filter(k % 10 != 0).withColumn("model", F.concat(F.lit("m"), (k % 2).cast("string"))).withColumn("eligible", k % 11 != 0)
    known = rows.filter(k % 10 == 0).withColumn("model", F.concat(F.lit("m"), F.floor(k % 4 / 2).cast("string"))).withColumn("cluster_id", k % 40)
    return samples, known


@query(
    "nearest_clusters",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), s AS (SELECT vec_id, vec_id % 3 AS scope, 'm' || vec_id % 2 AS model, (vec_id * 37 % 101) / 100 AS quality, vec_id % 11 <> 0 AS eligible, v, l FROM n WHERE vec_id % 10 <> 0),
    c AS (SELECT vec_id % 40 AS cluster_id, vec_id % 3 AS scope, 'm' || vec_id % 4 // 2 AS model, v, l FROM n WHERE vec_id % 10 = 0), p AS (SELECT s.vec_id, c.cluster_id, max(round(list_inner_product(s.v, c.v) / (s.l * c.l), 7)) AS score FROM s JOIN c ON s.scope = c.scope AND s.model = c.model WHERE eligible AND quality >= 0.3 GROUP BY ALL),
    b AS (SELECT vec_id, cluster_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster_id) AS r FROM p) WHERE r = 1 AND score >= 0.2)
    SELECT s.vec_id, b.cluster_id, coalesce(score, 0) AS score FROM s LEFT JOIN b USING (vec_id)""",
)
def nearest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known cluster of every arriving sample, in its scope and model."""
    samples, known = _arrivals(spark, sf_dir)
    return online.nearest_clusters(samples, known, "vec_id", threshold=0.2).withColumn("score", F.round("score", 7))


@query("online_clusters")
def online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples assigned one after the other to known clusters and to those that earlier ones founded; tests/test_models.py has a plain model."""
    samples, known = _arrivals(spark, sf_dir)
    return online.assign_online(samples, known, "vec_id", "vec_id", threshold=0.2)


_OPS = """m AS (SELECT vec_id AS sample, label AS cluster_id FROM embeddings), c AS (SELECT DISTINCT label AS cluster_id, CASE WHEN label = 3 THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN label = 3 THEN 'ann' END AS name FROM embeddings)"""


def _operated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = catalog.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("cluster_id"))
    known = members.select("cluster_id").distinct().select("cluster_id", F.when(F.col("cluster_id") == 3, "confirmed").otherwise("pending").alias("status"), F.when(F.col("cluster_id") == 3, "ann").alias("name"))
    ops = spark.sql("SELECT * FROM VALUES ('merge', 0, 1, CAST(NULL AS STRING), CAST(NULL AS ARRAY<BIGINT>)), ('split', 1, 1001, NULL, array(1L, 11L, 21L, 31L)), ('confirm', 2, NULL, 'bob', NULL), ('confirm', 4, NULL, 'ann', NULL), ('reject', 5, NULL, NULL, NULL) AS v(op, cluster_id, target, name, samples)")
    return clusters.operated(members, known, ops)


@query("cluster_members", f"WITH {_OPS} SELECT sample, CASE WHEN cluster_id = 0 THEN 1 WHEN cluster_id = 1 AND sample IN (1, 11, 21, 31) THEN 1001 WHEN cluster_id = 4 THEN 3 WHEN cluster_id = 5 THEN NULL ELSE cluster_id END AS cluster_id FROM m")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters after a merge, a split, two confirmations (one by a known name) and a rejection."""
    return _operated(spark, sf_dir)[0]


@query("cluster_states", f"WITH {_OPS} SELECT cluster_id, CASE WHEN cluster_id IN (0, 4, 5) THEN 'rejected' WHEN cluster_id = 2 THEN 'confirmed' ELSE status END AS status, CASE WHEN cluster_id = 2 THEN 'bob' ELSE name END AS name FROM c UNION ALL SELECT 1001, 'pending', NULL")
def cluster_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters themselves after those operations."""
    return _operated(spark, sf_dir)[1]


@query(
    "cluster_neighbours",
    """WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, d, sum(x) AS s FROM e GROUP BY ALL), l AS (SELECT label, sqrt(sum(s * s)) AS n FROM m GROUP BY ALL),
    p AS (SELECT a.label, b.label AS nearest, round(sum(a.s * b.s) / (any_value(x.n) * any_value(y.n)), 9) AS similarity FROM m a JOIN m b ON a.d = b.d AND a.label <> b.label JOIN l x ON x.label = a.label JOIN l y ON y.label = b.label GROUP BY ALL)
    SELECT label, nearest, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, nearest) AS r FROM p) WHERE r = 1""",
)
def cluster_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cluster the other one whose centroid is most alike."""
    return clusters.centroid_similarity(catalog.load(spark, sf_dir, "embeddings"), "label", "embedding")


@query("entity_clusters", "WITH f AS (SELECT l_suppkey AS cluster_id, count(*) AS n, arg_max(l_orderkey * 10 + l_linenumber, (l_quantity, l_orderkey * 10 + l_linenumber)) AS face, max((l_quantity, l_orderkey * 10 + l_linenumber)) AS b FROM lineitem GROUP BY ALL), h AS (SELECT s_nationkey AS n_nationkey, count(*) AS clusters, sum(n)::BIGINT AS faces, arg_max(face, b) AS avatar FROM supplier LEFT JOIN f ON cluster_id = s_suppkey GROUP BY ALL) SELECT n_nationkey, coalesce(clusters, 0) AS clusters, coalesce(faces, 0) AS faces, avatar FROM nation LEFT JOIN h USING (n_nationkey)")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities (nations) with their clusters (suppliers), faces (lines) and best face; those without a cluster too."""
    known = catalog.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_nationkey").cast("int").alias("n_nationkey"))
    faces = catalog.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face_id"), F.col("l_quantity").alias("quality"))
    return review.cards_with_clusters(catalog.load(spark, sf_dir, "nation"), known, faces, "n_nationkey")


# --- lifecycle -------------------------------------------------------------------------------------------------------


@query("upserted_vectors", "SELECT space, source_id, arg_max(vec_id, vec_id) AS vec_id FROM (SELECT label % 2 AS space, vec_id % 100 AS source_id, vec_id FROM embeddings) GROUP BY ALL")
def upserted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vector of each space and source after an upsert."""
    k = F.col("vec_id")
    rows = catalog.load(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("space"), F.lit("asset").alias("source_type"), (k % 100).alias("source_id"), F.lit("m").alias("model_name"), "vec_id", k.alias("updated_at"))
    return lifecycle.upsert_vectors(rows.filter(k % 3 != 0), rows.filter(k % 3 == 0)).select("space", "source_id", "vec_id")


@query("left_after_failures", "WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) SELECT 'lines' AS name, l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM g) GROUP BY ALL UNION ALL SELECT 'events', c_custkey, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT * FROM g))")
def left_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when every fifth asset (order) failed: its lines go, and events (customers) that it leaves empty."""
    orders = catalog.load(spark, sf_dir, "orders")
    bridge = orders.select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("event_id"))
    events = catalog.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"))
    left = lifecycle.without_derivatives({"lines": (catalog.load(spark, sf_dir, "lineitem"), "l_orderkey")}, bridge, events, bridge.filter("obs_id % 5 = 0").select("obs_id"))
    lines = left["lines"].groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("name"), "id", "n")
    return lines.unionAll(left["events"].select(F.lit("events"), "event_id", F.lit(1).cast("long")))


@query("revision_rows", "SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS before, 'NONE' AS after FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'NONE' UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR FROM customer WHERE c_custkey % 2 = 0")
def revision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for each field that a change of customers changed."""
    old = catalog.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    new = old.select("c_custkey", F.when(k % 3 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 2 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return lifecycle.revisions(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("applied_corrections", "WITH r AS (SELECT user_id, event_id % 4 AS revision, max(event_type) AS value FROM events GROUP BY ALL), l AS (SELECT user_id, max(revision) AS r FROM r GROUP BY ALL) SELECT * FROM r UNION ALL SELECT l.user_id, l.r + 1, 'fixed' FROM l WHERE l.user_id % 2 = 0 AND l.r = 3")
def applied_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions with corrections that are unexpired and were made on the current one."""
    rows = _events(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 4).alias("revision")).agg(F.max("event_type").alias("value"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    expires = F.when(F.col("user_id") % 2 == 0, F.lit("2024-02-02 00:00:00")).otherwise(F.lit("2024-01-02 00:00:00")).cast("timestamp_ntz")
    proposals = rows.select("user_id").distinct().select("user_id", F.lit("t").alias("token"), F.lit(3).cast("long").alias("base_revision"), F.lit("fixed").alias("value"), expires.alias("expires_at"))
    return lifecycle.apply_corrections(rows, proposals, ["user_id"], now).select("user_id", "revision", "value")


@query("grown_schema", "SELECT n_nationkey, n_name, 'home' AS scope_id, 0 AS revision FROM nation")
def grown_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older schema with the columns of the later one."""
    rows = catalog.load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return lifecycle.with_columns(rows, {"n_name": ("string", ""), "scope_id": ("string", "home"), "revision": ("int", 0)})


@query("candidate_states", "WITH d AS (SELECT user_id, arg_max(event_type, event_id) AS last, count(*) FILTER (event_type IN ('purchase', 'error')) AS n, arg_max(event_type, event_id) FILTER (event_type <> 'signup') AS verdict FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY ALL) SELECT c_custkey AS user_id, CASE verdict WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, coalesce(n, 0) + 1 AS revision FROM customer LEFT JOIN d ON user_id = c_custkey WHERE coalesce(last <> 'signup', true)")
def candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (customers) after confirmations, rejections and deletions."""
    kind = F.col("event_type")
    log = _events(spark, sf_dir).filter(kind.isin("purchase", "error", "signup")).select("user_id", F.when(kind == "purchase", "confirm").when(kind == "error", "reject").otherwise("delete").alias("action"), F.col("event_id").alias("at"))
    return lifecycle.candidate_states(catalog.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), log, "user_id")


@query("rebuild_list", "WITH d AS (SELECT o_custkey AS k, max(o_orderkey % 7) AS done FROM orders GROUP BY ALL) SELECT c_custkey, CASE WHEN done IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM customer LEFT JOIN d ON k = c_custkey WHERE done IS NULL OR done < c_custkey % 7")
def rebuild_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backfill has to make anew."""
    sources = catalog.load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("revision"))
    derived = catalog.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 7).alias("revision"))
    return lifecycle.to_rebuild(sources, derived, "c_custkey")


@query("unexpired_results", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR")
def unexpired_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that live for a day."""
    return lifecycle.unexpired(_events(spark, sf_dir), "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 24.0).select("event_id")


@query("demoted_items", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY THEN 'stale' ELSE o_orderstatus END AS status FROM orders")
def demoted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that weren't used for ninety days."""
    rows = catalog.load(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    return lifecycle.demoted(rows, "o_orderdate", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "status")


@query("open_gaps", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, ts) AS s FROM events GROUP BY ALL) WHERE s IN ('error', 'view')")
def open_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps (users) whose last entry leaves them open."""
    log = _events(spark, sf_dir).withColumn("status", F.when(F.col("event_type").isin("error", "view"), "open").otherwise("done"))
    return lifecycle.open_gaps(log, "user_id", "ts").select("user_id")


@query("entity_merges", "SELECT min(s_suppkey) AS keep, s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2")
def entity_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as candidates for a merge."""
    rows = catalog.load(spark, sf_dir, "supplier").withColumn("kind", F.lit("place"))
    return entities.merge_candidates(rows, "s_nationkey", "s_suppkey", "kind", ("place", "object")).select("keep", "s_nationkey", "n")


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.event_stream(spark, sf_dir, "events.parquet", _events(spark, sf_dir).schema)


@query("stream_closed_windows", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start_ts, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts in append mode: windows are written once the watermark has passed them, and then leave the state."""
    counts = streams.window_counts(_stream(spark, sf_dir), "event_type", "ts", "1 hour", watermark="10 minutes")
    out = streams.run_available(counts, streams.scratch(spark, "closed"), streams.scratch(spark, "offsets"))
    return out.select(F.date_format("start_ts", _TS).alias("start_ts"), "event_type", "n")


@query("stream_pairs", "SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour of a view: two streams joined, with watermarks on both."""
    views = _stream(spark, sf_dir).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    bought = _stream(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    pairs = streams.paired(views, bought, "user_id", "view_ts", "purchase_ts", "1 hour", "30 days").select("view_id", "purchase_id")
    return streams.run_available(pairs, streams.scratch(spark, "pairs"), streams.scratch(spark, "offsets"))


@query("stream_commits", "SELECT event_id, upper(event_type) AS kind FROM events")
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches prepared in parallel and committed in order, each once however often it runs."""
    out, offsets = streams.scratch(spark, "commits"), streams.scratch(spark, "offsets")
    prepare = lambda batch: batch.select("event_id", F.upper("event_type").alias("kind"))
    streams.consume(_stream(spark, sf_dir), offsets, prepare, out)
    streams.consume(_stream(spark, sf_dir), offsets, prepare, out)  # nothing is left: nothing is written twice
    return spark.read.parquet(out).select("event_id", "kind")


@query("stream_log", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that a stream appends to."""
    rows = _stream(spark, sf_dir).filter("event_type = 'error'").select("event_id", "user_id")
    return streams.run_available(rows, streams.scratch(spark, "log"), streams.scratch(spark, "offsets"))


@query("stream_assignment")
def stream_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online assignment with the open events of each user as state; tests/test_models.py holds it against a batch."""
    rows = queries_events.of_events(_stream(spark, sf_dir))
    return streams.run_available(streams.assigned_online(rows), streams.scratch(spark, "assigned"), streams.scratch(spark, "offsets"))


@query("blocked_pairs", "SELECT count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000")
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a user's events lie within an hour: pairs blocked by user and time slot."""
    rows = _events(spark, sf_dir)
    a = rows.select("user_id", F.col("event_id").alias("i"), F.col("ts").alias("t1"))
    b = rows.select("user_id", F.col("event_id").alias("j"), F.col("ts").alias("t2"))
    return joins.within(a, b, ["user_id"], "t1", "t2", 3600).filter("i < j").agg(F.count(F.lit(1)).alias("pairs"))


_CLOSED = "(SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_outer_pairs",
    f"""WITH p AS (SELECT a.event_id AS view_id, a.ts, b.event_id AS purchase_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view')
    SELECT view_id, purchase_id FROM p WHERE purchase_id IS NOT NULL OR ts + INTERVAL 1 HOUR < {_CLOSED}""",
)
def stream_outer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases within an hour, and those without any, once none can come any more: two streams, outer join."""
    views = _stream(spark, sf_dir).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    bought = _stream(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    pairs = streams.paired(views, bought, "user_id", "view_ts", "purchase_ts", "1 hour", "10 minutes", "left_outer").select("view_id", "purchase_id")
    return streams.run_available(pairs, streams.scratch(spark, "pairs"), streams.scratch(spark, "offsets"))


@query("stream_once", "SELECT event_id, user_id FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is delivered twice, each event taken in once."""
    twice = _stream(spark, sf_dir).unionByName(_stream(spark, sf_dir)).select("event_id", "user_id", "ts")
    rows = streams.once(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id")
    return streams.run_available(rows, streams.scratch(spark, "once"), streams.scratch(spark, "offsets"))


@query("stream_sliding_windows", "SELECT strftime(time_bucket(INTERVAL 30 minute, ts) - to_minutes(30 * k), '%Y-%m-%d %H:%M:%S') AS start_ts, event_type, count(*) AS n FROM events, range(0, 2) AS r(k) GROUP BY ALL")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an hour, every half hour, by type."""
    counts = streams.window_counts(_stream(spark, sf_dir), "event_type", "ts", "1 hour", "30 minutes")
    out = streams.run_complete(counts, streams.scratch(spark, "sliding"), streams.scratch(spark, "offsets"))
    return out.select(F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "event_type", "n")


@query(
    "stream_expiries",
    """WITH g AS (SELECT user_id, epoch_ms(ts) AS t, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER w <= 86400000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS life FROM g), l AS (SELECT user_id, life, min(t) AS opened, max(t) + 86400000 AS expired, count(*) AS n FROM s GROUP BY ALL)
    SELECT user_id, strftime(make_timestamp(opened * 1000), '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(make_timestamp(expired * 1000), '%Y-%m-%d %H:%M:%S') AS expired_at, n FROM l
    WHERE expired <= (SELECT max(epoch_ms(ts)) - 600000 FROM events) OR life < (SELECT max(life) FROM l x WHERE x.user_id = l.user_id)""",
)
def stream_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result sets that users' events open and renew, and that have expired a day after the last of them."""
    ended = expiry.lives(_stream(spark, sf_dir), "user_id", "ts", expiry.RESULT_SECONDS, "10 minutes")
    out = streams.run_available(ended, streams.scratch(spark, "lives"), streams.scratch(spark, "offsets"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", day("opened_at"), day("expired_at"), "n")
