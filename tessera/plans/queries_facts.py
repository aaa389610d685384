"""Structured facts, scans, counters, places and text values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.text import hard_values, normalise, prompt_tokens, search_tokens, short_title
from tessera.functions.time import calendar
from tessera.operators import lifecycle, scans, structured
from tessera.operators.metrics import counts_by
from tessera.plans.spec import QuerySpec, spec_from_filters
from tessera.registry import query

_TS = "yyyy-MM-dd HH:mm:ss"


@query(
    "facts_count_by_media_month",
    "SELECT event_type AS media_type, strftime(ts, '%Y-%m') AS month, count(DISTINCT event_id) AS n FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-01' AND event_type IN ('view', 'click', 'purchase') GROUP BY ALL",
)
def facts_count_by_media_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct assets by media type and month within a half-open time range."""
    spec = QuerySpec(media=("view", "click", "purchase"), start=datetime(2024, 1, 5), end=datetime(2024, 2, 1))
    kept = structured.filtered(catalog.assets(spark, sf_dir), spec)
    return kept.groupBy("media_type", structured.group_key("month", kept.columns).alias("month")).agg(F.countDistinct("asset_id").alias("n"))


@query("facts_count_january", "SELECT count(DISTINCT event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def facts_count_january(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count from a filters mapping with a time expression."""
    return structured.execute(catalog.assets(spark, sf_dir), spec_from_filters({"time": "2024年1月", "operation": "count"}, datetime(2024, 6, 1)))


@query("facts_first_last_range", "SELECT event_type AS media_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def facts_first_last_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.assets(spark, sf_dir).groupBy("media_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.countDistinct("asset_id").alias("n"))
    return rows.select("media_type", F.date_format("a", _TS).alias("first_ts"), F.date_format("b", _TS).alias("last_ts"), "n")


@query("facts_exists_by_user", "SELECT user_id AS scope_id, bool_or(event_type = 'purchase' AND ts < TIMESTAMP '2024-01-10') AS found FROM events GROUP BY user_id")
def facts_exists_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("media_type") == "purchase") & (F.col("ts") < F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz"))
    return catalog.assets(spark, sf_dir).groupBy("scope_id").agg(F.bool_or(hit).alias("found"))


@query(
    "facts_place_groups_with_coverage",
    """WITH p AS (SELECT coalesce(n_name, 'unknown') AS g FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal >= 0),
       c AS (SELECT g, count(*) AS n FROM p GROUP BY g)
       SELECT g, n, sum(CASE WHEN g <> 'unknown' THEN n ELSE 0 END) OVER () AS known, sum(CASE WHEN g = 'unknown' THEN n ELSE 0 END) OVER () AS unknown, sum(n) OVER () AS total FROM c""",
)
def facts_place_groups_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = structured.execute(catalog.places(spark, sf_dir), QuerySpec(operation="group_count", group_by="place"))
    return groups.crossJoin(F.broadcast(structured.coverage(groups)))  # one row


@query(
    "place_hierarchy",
    """WITH p AS (SELECT coalesce(r_name, 'unknown') AS o, coalesce(n_name, 'unknown') AS i FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal >= 0 LEFT JOIN region ON r_regionkey = n_regionkey)
       SELECT o AS outer_place, i AS inner_place, count(*) AS n, (sum(count(*)) OVER (PARTITION BY o))::BIGINT AS outer_n, CASE WHEN o = 'unknown' THEN 1 ELSE 0 END AS last FROM p GROUP BY o, i""",
)
def place_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.hierarchy(catalog.places(spark, sf_dir), "place", "city")


@query("place_match", "SELECT c_custkey AS asset_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal >= 0 AND (contains(lower(r_name), 'asia') OR (length(trim(n_name)) >= 2 AND contains('asia', trim(n_name))))")
def place_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.filtered(catalog.places(spark, sf_dir), QuerySpec(place="asia")).select("asset_id")


@query(
    "calendar_labels",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, year(ts) AS year, month(ts) AS month,
       CASE WHEN month(ts) IN (3,4,5) THEN 'spring' WHEN month(ts) IN (6,7,8) THEN 'summer' WHEN month(ts) IN (9,10,11) THEN 'autumn' ELSE 'winter' END AS season,
       CASE WHEN hour(ts) < 5 THEN 'night' WHEN hour(ts) < 8 THEN 'early morning' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 20 THEN 'dusk' ELSE 'evening' END AS part_of_day,
       count(*) AS n FROM events GROUP BY ALL""",
)
def calendar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.assets(spark, sf_dir).select(*calendar(F.col("ts")))
    return rows.groupBy("date", "year", "month", "season", "part_of_day").agg(F.count(F.lit(1)).alias("n"))


@query("scan_newest_assets", "SELECT event_id AS asset_id, event_type AS media_type FROM events WHERE event_type <> 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 200")
def scan_newest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 assets that aren't errors (a top-k report)."""
    return scans.newest(catalog.assets(spark, sf_dir), "ts", "asset_id", 200, F.col("media_type") != "error").select("asset_id", "media_type")


@query("dashboard_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("events", "documents", "conversations", "embeddings", "labels", "customer")))
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.counters({t: catalog.load(spark, sf_dir, t) for t in ("events", "documents", "conversations", "embeddings", "labels", "customer")})


@query("facet_values", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.facets(catalog.load(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


@query("paged_results", "SELECT doc_id, ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS ordinal FROM documents) WHERE ordinal > 20 AND ordinal <= 40")
def paged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty, with stable ordinals."""
    return scans.paged(catalog.load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 2, 20).select("doc_id", "ordinal")


@query("near_duplicates", "SELECT doc_id, min(doc_id) OVER w AS leader, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS is_leader FROM documents WINDOW w AS (PARTITION BY sha256(text))")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.near_duplicate_groups(catalog.load(spark, sf_dir, "documents"), "text", "doc_id")


@query("content_hash_earliest", "SELECT sha256(text) AS content_sha256, source, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def content_hash_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.load(spark, sf_dir, "documents").select("doc_id", "text", "source").withColumn("created", F.col("doc_id"))
    return scans.earliest_by_hash(docs, "text", "created", "doc_id", ("source",)).select("content_sha256", "source", "doc_id", "copies")


@query(
    "hard_value_extraction",
    """WITH y AS (SELECT doc_id, 'year' AS kind, unnest(regexp_extract_all(regexp_replace(' ' || text || ' ', '(\\d+)', ' \\1 ', 'g'), ' ((?:19|20)\\d{2}) ', 1)) AS value FROM documents),
       p AS (SELECT doc_id, 'phone' AS kind, unnest(regexp_extract_all(regexp_replace(' ' || text || ' ', '(\\d+)', ' \\1 ', 'g'), ' (\\d{7,12}) ', 1)) AS value FROM documents)
       SELECT doc_id, kind, value, count(*) AS n FROM (SELECT * FROM y UNION ALL SELECT * FROM p) GROUP BY ALL""",
)
def hard_value_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, years and phone numbers of all documents. The SQL has no prices, which stand in no driver text."""
    docs = catalog.load(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]"))
    values = docs.select("doc_id", F.explode(hard_values(F.col("text"))).alias("v")).select("doc_id", "v.kind", "v.value")
    return values.groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "search_token_counts",
    """WITH v AS (SELECT conv_id, turn, regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', ' ', 'g') AS s FROM conversations),
       c AS (SELECT conv_id, turn, s, list_filter(string_split(regexp_replace(s, '\\s', '', 'g'), ''), lambda x: x <> '') AS ch FROM v)
       SELECT conv_id, turn, len(list_distinct(list_concat(list_concat(CASE WHEN length(s) > 1 THEN [s] ELSE [] END, regexp_extract_all(s, '[a-zA-Z0-9]+')), [ch[i] || ch[i + 1] for i in range(1, len(ch))])))::INTEGER AS tokens FROM c""",
)
def search_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct search tokens (whole, words, bigrams) every message has."""
    return catalog.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(search_tokens(F.col("text"))).alias("tokens"))


@query("prompt_token_estimates", "SELECT source, sum(floor(length(text) * 0.25 + 400))::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY source")
def prompt_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.load(spark, sf_dir, "documents").select("source", "text")
    return docs.groupBy("source").agg(F.sum(prompt_tokens(F.coalesce("text", F.lit("")))).alias("tokens"), F.count(F.lit(1)).alias("n"))


@query("conversation_titles", "SELECT conv_id, CASE WHEN length(l) > 24 THEN substr(l, 1, 24) || '…' ELSE l END AS title FROM (SELECT conv_id, trim(string_split(trim(arg_min(text, turn)), chr(10))[1]) AS l FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title of each conversation: its first user message, cut."""
    first = catalog.load(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", short_title(F.col("text")).alias("title"))


@query("batch_status", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return counts_by(rows, "status", "priority")


@query("json_path_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("orphan_files", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label refers to: an anti-join."""
    return lifecycle.orphans(catalog.load(spark, sf_dir, "documents").select("doc_id"), "doc_id", catalog.load(spark, sf_dir, "labels"), "doc_id")


@query(
    "majority_model_vectors",
    """WITH v AS (SELECT vec_id, label % 3 AS space, 'm' || ((vec_id % 5) // 2)::BIGINT::VARCHAR AS model_name FROM embeddings),
    m AS (SELECT space, model_name, row_number() OVER (PARTITION BY space ORDER BY count(*) DESC, model_name) AS r FROM v GROUP BY space, model_name)
    SELECT v.vec_id, v.space, v.model_name FROM v JOIN m ON v.space = m.space AND v.model_name = m.model_name AND r = 1""",
)
def majority_model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each space's most frequent model."""
    v = catalog.load(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("space"), F.concat(F.lit("m"), F.floor((F.col("vec_id") % 5) / 2).cast("string")).alias("model_name"), F.col("embedding").alias("vector"))
    return lifecycle.majority_model(v).select("vec_id", "space", "model_name")


@query("normalised_duplicates", "SELECT regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', ' ', 'g') AS value, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def normalised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are equal once normalised."""
    return catalog.load(spark, sf_dir, "conversations").groupBy(normalise(F.col("text")).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
