"""Column functions, each on a whole table against SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import geo, text, time, vector
from tessera.operators import structured, text_index
from tessera.plans.spec import QuerySpec, spec_from_filters
from tessera.registry import query

_TS = "yyyy-MM-dd HH:mm:ss"


@query("iso_times", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS t FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times read from text: with a zone, with an offset, a bare day, and a bare year, which is none."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+08:00"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy"))
    return catalog.load(spark, sf_dir, "events").select("event_id", F.date_format(time.parse_iso(said), _TS).alias("t"))


@query("exif_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '+02:00' ELSE '' END AS t FROM events")
def exif_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a camera, with its offset where it has one."""
    return catalog.load(spark, sf_dir, "events").select("event_id", time.normalise_exif(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00")).alias("t"))


@query("offset_times", "SELECT event_id, strftime(date_trunc('second', ts) + to_microseconds(round(value * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def offset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start and seconds into a video make a time."""
    return catalog.load(spark, sf_dir, "events").select("event_id", F.date_format(time.add_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("value")), _TS).alias("t"))


@query("relative_range_counts", "SELECT 'last year' AS said, count(*) FILTER (year(ts) = 2024) AS n FROM events UNION ALL SELECT 'two months ago', count(*) FILTER (strftime(ts, '%Y-%m') = '2024-01') FROM events UNION ALL SELECT 'spring before', count(*) FILTER (month(ts) BETWEEN 3 AND 5 AND year(ts) = 2024) FROM events")
def relative_range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in ranges that relative expressions name."""
    assets = catalog.assets(spark, sf_dir)
    asked = {"last year": ("去年", datetime(2025, 6, 1)), "two months ago": ("上上个月", datetime(2024, 3, 5)), "spring before": ("去年春天", datetime(2025, 6, 1))}
    out = None
    for said, (value, now) in asked.items():
        one = structured.execute(assets, spec_from_filters({"time": value}, now)).withColumn("said", F.lit(said))
        out = one if out is None else out.unionByName(one)
    return out


@query("extracted_range_count", "SELECT count(DISTINCT event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def extracted_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count in the range that a question's own words name."""
    start, end = time.extract_range("我想看2024年1月拍的照片", datetime(2025, 1, 1))
    return structured.execute(catalog.assets(spark, sf_dir), QuerySpec(start=start, end=end))


@query("parsed_positions", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL ELSE (c_custkey % 90) / 2 END AS lat, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE c_custkey % 180 END AS lon FROM customer")
def parsed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions read from text; what is out of range, or is (0, 0), is none."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, "0, 0").when(k % 4 == 1, "91,20").otherwise(F.concat_ws(", ", (k % 90 / 2).cast("string"), (k % 180).cast("string")))
    at = geo.parse_latlon(said)
    return catalog.load(spark, sf_dir, "customer").select("c_custkey", at["lat"].alias("lat"), at["lon"].alias("lon"))


@query("decimal_degrees", "SELECT c_custkey, round((c_custkey % 90 + c_custkey % 60 / 60 + c_custkey % 50 / 3600) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END, 9) AS degrees FROM customer")
def decimal_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return catalog.load(spark, sf_dir, "customer").select("c_custkey", F.round(geo.from_dms(k % 90, k % 60, k % 50, F.when(k % 2 == 0, "s").otherwise("N")), 9).alias("degrees"))


@query("unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS manhattan FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the absolute components of each vector at length 1."""
    unit = vector.l2_normalised(F.col("embedding"))
    return catalog.load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda acc, x: acc + F.abs(x)), 6).alias("manhattan"))


@query("face_quality", "SELECT vec_id, round(0.4 * least(1, greatest(0, vec_id % 13 / 10)) + 0.2 * (vec_id % 7 / 7) + 0.2 * (vec_id % 5 / 5) + 0.2 * (vec_id % 3 / 3), 9) AS quality, CASE WHEN vec_id % 9 = 0 THEN 'unknown' WHEN vec_id % 81 - 40 > 20 THEN 'left' WHEN vec_id % 81 - 40 < -20 THEN 'right' ELSE 'frontal' END AS pose FROM embeddings")
def face_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and view of faces."""
    k = F.col("vec_id")
    return catalog.load(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.quality(k % 13 / 10, k % 7 / 7, k % 5 / 5, k % 3 / 3), 9).alias("quality"), vector.pose_bucket(F.when(k % 9 != 0, k % 81 - 40)).alias("pose"))


@query(
    "box_relations",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_suppkey % 20 AS y1, l_quantity + 10 AS x2, l_suppkey % 20 + 10 AS y2 FROM lineitem)
    SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, round(sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) / sqrt(2), 9) AS apart,
    (a.x1 + a.x2) / 2 BETWEEN b.x1 - 2.5 AND b.x2 + 2.5 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 - 2.5 AND b.y2 + 2.5 AS beside FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""",
)
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the centres of an order's boxes are apart, and whether one lies in the other's box, widened by 2.5."""
    box = F.struct(F.col("l_quantity").alias("x1"), (F.col("l_suppkey") % 20).alias("y1"), (F.col("l_quantity") + 10).alias("x2"), (F.col("l_suppkey") % 20 + 10).alias("y2"))
    rows = catalog.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("box").alias("a"))
    b = rows.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("box").alias("b"))
    apart = F.round(vector.centre_distance(F.col("a"), F.col("b")), 9).alias("apart")
    return a.join(b, "l_orderkey").filter("i < j").select("l_orderkey", "i", "j", apart, vector.within_expanded(vector.centre(F.col("a")), F.col("b"), 2.5).alias("beside"))


@query(
    "box_overlaps",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_suppkey % 20 AS y1, l_quantity + 10 AS x2, l_suppkey % 20 + 10 AS y2 FROM lineitem)
    SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, round(w * h / (200 - w * h), 9) AS iou FROM (SELECT a, b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS w, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS h FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber) WHERE w * h > 0""",
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order that overlap, and how much."""
    box = F.struct(F.col("l_quantity").alias("x1"), (F.col("l_suppkey") % 20).alias("y1"), (F.col("l_quantity") + 10).alias("x2"), (F.col("l_suppkey") % 20 + 10).alias("y2"))
    rows = catalog.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("box").alias("a"))
    b = rows.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("box").alias("b"))
    pairs = a.join(b, "l_orderkey").filter("i < j").withColumn("iou", F.round(vector.iou(F.col("a"), F.col("b")), 9))
    return pairs.filter("iou > 0").select("l_orderkey", "i", "j", "iou")


@query("label_jaccard", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 1/3 ELSE 0 END AS jaccard FROM part")
def label_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of two label sets."""
    k = F.col("p_size") % 3
    other = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("x")))
    return catalog.load(spark, sf_dir, "part").select("p_partkey", vector.jaccard(F.array(F.lit("a"), F.lit("b")), other).alias("jaccard"))


@query("word_sets", "SELECT conv_id, turn, len(list_distinct(list_filter(string_split_regex(lower(text), '[\\s、，]+'), lambda w: w <> '')))::INTEGER AS words FROM conversations")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct tokens every message has, parted by white space and CJK commas."""
    return catalog.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.token_set(F.col("text"))).alias("words"))


@query("mapped_labels", "SELECT CASE trim(p_type) WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'offer' ELSE trim(p_type) END AS label, count(*) AS n FROM part GROUP BY ALL")
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in a controlled vocabulary."""
    label = text.mapped(F.concat(F.lit(" "), "p_type"), {"ECONOMY": "cheap", "PROMO": "offer"})
    return catalog.load(spark, sf_dir, "part").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("first_categories", "SELECT CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'colour' WHEN contains(p_name, 'ring') THEN 'jewel' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY ALL")
def first_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first category of which a term is in the name."""
    category = text.first_category(F.col("p_name"), [("colour", ["red", "blue"]), ("jewel", ["ring"])], "other")
    return catalog.load(spark, sf_dir, "part").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("internal_id_leaks", "SELECT event_id, event_id % 3 < 2 AS leaks FROM events")
def internal_id_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that show an internal id or an unfilled placeholder."""
    k = F.col("event_id")
    said = F.when(k % 3 == 0, F.concat(F.lit("see asset_0123456789"), F.lpad(k.cast("string"), 6, "0"))).when(k % 3 == 1, F.lit("hello {{ name }}")).otherwise(F.lit("an asset_of mine"))
    return catalog.load(spark, sf_dir, "events").select("event_id", text.leaks_internal_id(said).alias("leaks"))


@query("claim_segments", "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$'), lambda s: trim(s) <> ''))::INTEGER AS claims, length(text) AS n FROM documents")
def claim_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims the sentence marks of a document part it into, and that they reach to its end."""
    rows = catalog.load(spark, sf_dir, "documents").select("doc_id", "text", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("claims"), F.length("text").cast("long").alias("n"))


@query("claim_kinds", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 'count' WHEN regexp_matches(lower(text), 'the|der') THEN 'place' ELSE 'statement' END AS kind FROM conversations")
def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of claim that a message's words make it."""
    kind = text.claim_kind(F.col("text"), [("count", "[0-9]"), ("place", "(?i)the|der")])
    return catalog.load(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query("cjk_token_estimates", "SELECT p_partkey, floor(4 * 0.7 + (length(p_name)) * 0.25 + 400)::BIGINT AS tokens FROM part")
def cjk_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tokens of names with four CJK characters before them."""
    return catalog.load(spark, sf_dir, "part").select("p_partkey", text.prompt_tokens(F.concat(F.lit("杭州西湖"), "p_name")).alias("tokens"))


@query("like_search", "SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', ' ', 'g'), 'the')")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose field contains a string."""
    values = text_index.field_values(catalog.load(spark, sf_dir, "documents"), "doc_id", {"text": "text", "source": "source"})
    return text_index.like_search(values, "doc_id", "text", "the ")


@query("term_index_counts", "WITH v AS (SELECT conv_id, turn, regexp_replace(lower(trim(coalesce(role, ''))), '\\s+', ' ', 'g') AS s FROM conversations), c AS (SELECT conv_id, turn, s, string_split(regexp_replace(s, '\\s', '', 'g'), '') AS ch FROM v), k AS (SELECT conv_id, unnest(list_distinct(list_concat(list_concat([s], regexp_extract_all(s, '[a-zA-Z0-9]+')), [ch[i] || ch[i + 1] for i in range(1, len(ch))]))) AS token FROM c) SELECT token, count(*) AS rows FROM k GROUP BY ALL")
def term_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term projection of a field, counted by token: a full rebuild."""
    rows = catalog.load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return text_index.term_projection(rows, "key", {"role": "role"}).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


@query("place_filter", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal >= 0 AND (contains(lower(n_name), 'ger') OR contains(lower(r_name), 'ger') OR contains(lower(n_name), 'france') OR contains(lower(r_name), 'france'))")
def place_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by any of several fields, or by an alias of what is asked for."""
    rows = catalog.places(spark, sf_dir)
    return rows.filter(structured.place_filter("ger", [F.col("city"), F.col("place")], {"ger": ("france",)})).select(F.col("asset_id").alias("c_custkey"))


@query("position_labels", "SELECT c_custkey, CASE WHEN r_name IS NULL THEN '' WHEN r_name = 'ASIA' THEN coalesce(r_name, '') || n_name ELSE n_name || ', ' || r_name END AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal >= 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def position_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of places: outer before inner where that is the custom (here Asia), else inner, comma, outer."""
    label = text.place_label(F.col("city"), F.col("place"), F.col("place") == "ASIA")
    return catalog.places(spark, sf_dir).select(F.col("asset_id").alias("c_custkey"), label.alias("label"))


@query("scoped_counts", "SELECT count(DISTINCT event_id) AS n FROM events WHERE user_id = 3 AND event_type IN ('view', 'click') AND event_type <> 'click' AND event_id IN (SELECT event_id FROM events WHERE event_id % 6 IN (1, 2))")
def scoped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count in one scope, with media in and out, and any of two entities."""
    assets = catalog.assets(spark, sf_dir)
    mentions = assets.select("asset_id", (F.col("asset_id") % 6).cast("string").alias("entity_id"))
    spec = QuerySpec(scope_id="3", media=("view", "click"), not_media=("click",), entity_ids=("1", "2"))
    return structured.execute(assets.withColumn("scope_id", F.col("scope_id").cast("string")), spec, mentions)


@query("grouped_lists", "WITH g AS (SELECT event_type || o AS g, count(DISTINCT event_id) AS n FROM (SELECT event_id, event_type, unnest(CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS o FROM events) GROUP BY ALL) SELECT g, n, (sum(n) OVER ())::BIGINT AS total FROM g")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of assets by what their observations say, and the sum of their counts (an asset may be in several)."""
    rows = catalog.assets(spark, sf_dir)
    seen = rows.select("asset_id", F.explode(F.when(F.col("asset_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("o"))
    groups = structured.grouped_with_observations(rows, seen, F.concat("media_type", "o"))
    return groups.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("total"))))  # one row


@query("distinct_months", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS g FROM events")
def distinct_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct days of the event log."""
    return structured.execute(catalog.assets(spark, sf_dir), QuerySpec(operation="distinct", group_by="date"))
