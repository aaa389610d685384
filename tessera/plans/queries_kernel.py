"""The retrieval kernel end to end, over the event log as assets with one or two observations each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.vector import set_overlap
from tessera.operators import joins, kernel, retrieval
from tessera.plans.spec import HARD, SEMANTIC, Constraint
from tessera.registry import query

_DATA = """a AS (SELECT event_id AS asset_id, user_id AS scope_id, ts, event_type AS media_type, user_id * 1000 + epoch_us(ts) // 43200000000 % 1000 AS event_id, event_id % 97 AS album, value FROM events),
ob AS (SELECT asset_id * 2 AS obs_id, asset_id, CASE WHEN asset_id % 3 = 0 THEN 'u1' ELSE 'u2' END AS person, CASE WHEN asset_id % 4 = 0 THEN 'a dog runs' WHEN asset_id % 7 = 0 THEN 'U1 stands' ELSE 'nothing' END AS text FROM a WHERE asset_id % 5 <> 0
  UNION ALL SELECT asset_id * 2 + 1, asset_id, 'u' || asset_id % 6, 'Dog and cat' FROM a WHERE asset_id % 2 = 0)"""
#: Status of the three conditions (media click, person u1, object dog) of an asset and observation, and what follows from them.
_JUDGED = """SELECT {keys}, CASE WHEN person = 'u1' THEN 2 WHEN contains(lower(text), 'u1') THEN 1 ELSE 0 END AS p, CASE WHEN contains(lower(text), 'dog') THEN 1 ELSE 0 END AS d, coalesce(obs_id, -1) AS o FROM {rows} JOIN a USING (asset_id) LEFT JOIN ob USING (asset_id) WHERE media_type = 'click'"""
_LEVEL = "CASE WHEN least(p, 1) + d = 2 THEN 1 ELSE 2 END"
_BEST = f"SELECT * FROM (SELECT *, {_LEVEL} AS lv, (1 + CASE WHEN p = 2 THEN 1 ELSE 0 END) / 3 AS score, row_number() OVER (PARTITION BY {{keys}} ORDER BY {_LEVEL}, CASE WHEN p = 2 THEN 0 ELSE 1 END, o) AS r FROM ({_JUDGED})) WHERE r = 1"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    half_day = F.col("user_id") * 1000 + F.floor(joins.micros("ts") / 43_200_000_000) % 1000
    return catalog.load(spark, sf_dir, "events").select(F.col("event_id").alias("asset_id"), F.col("user_id").alias("scope_id"), "ts", F.col("event_type").alias("media_type"), half_day.alias("event_id"), (F.col("event_id") % 97).alias("album"), "value")


def _observations(assets: DataFrame) -> DataFrame:
    k = F.col("asset_id")
    place = F.lit(None).cast("string").alias("place")
    text = F.when(k % 4 == 0, "a dog runs").when(k % 7 == 0, "U1 stands").otherwise("nothing")
    one = assets.filter(k % 5 != 0).select((k * 2).alias("obs_id"), "asset_id", place, F.array(F.when(k % 3 == 0, "u1").otherwise("u2")).alias("people"), text.alias("text"))
    two = assets.filter(k % 2 == 0).select((k * 2 + 1).alias("obs_id"), "asset_id", place, F.array(F.concat(F.lit("u"), (k % 6).cast("string"))).alias("people"), F.lit("Dog and cat").alias("text"))
    return one.unionByName(two)


_ASKED = (Constraint("media", "click", SEMANTIC), Constraint("person", "u1", SEMANTIC), Constraint("object", "dog", SEMANTIC))


def _hits(assets: DataFrame) -> DataFrame:
    """Three queries (q): the visual channel likes values near 20 q, the entity channel finds every (q + 5)th asset."""
    queries = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("query_id")
    near = -F.abs(F.col("value") - F.col("query_id") * 20)
    rank = lambda *by: F.row_number().over(W.partitionBy("query_id").orderBy(*by))
    visual = assets.select("asset_id", "value", queries).withColumn("raw_score", F.round(near, 6)).withColumn("rank", rank(F.desc("raw_score"), "asset_id")).filter("rank <= 60")
    visual = visual.select("query_id", F.lit("visual").alias("channel"), "asset_id", "raw_score", "rank")
    mentions = assets.select("asset_id", queries).filter(F.col("asset_id") % (F.col("query_id") + 5) == 0).select("asset_id", F.col("query_id").alias("entity_id"))
    asked = assets.sparkSession.createDataFrame([(i, i) for i in (1, 2, 3)], "query_id int, entity_id int")
    return retrieval.union_hits(visual, *kernel.recall({"entity": True, "text": False}, {"entity": {"mentions": mentions, "queries": asked, "k": 60}}))


_MULTI = f"""WITH {_DATA}, qs AS (SELECT unnest([1, 2, 3]) AS q), vis AS (SELECT q, asset_id, row_number() OVER (PARTITION BY q ORDER BY round(-abs(value - q * 20), 6) DESC, asset_id) AS r FROM a, qs), ent AS (SELECT q, asset_id, row_number() OVER (PARTITION BY q ORDER BY asset_id) AS r FROM a, qs WHERE asset_id % (q + 5) = 0),
h AS (SELECT q, asset_id, 0 AS c, r FROM vis WHERE r <= 60 UNION ALL SELECT q, asset_id, 1, r FROM ent WHERE r <= 60), f AS (SELECT q, asset_id, min((c, r)) AS "at" FROM h GROUP BY ALL), rk AS (SELECT q, asset_id, row_number() OVER (PARTITION BY q ORDER BY "at", asset_id) AS position FROM f),
c1 AS (SELECT * FROM rk WHERE position <= 80), p AS ({_BEST.format(keys="q, asset_id, position", rows="c1")}),
s AS (SELECT q, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY position) AS n FROM p WHERE lv = 1) WHERE n <= 8), so AS (SELECT s.q, a.* FROM s JOIN a USING (asset_id)),
t AS (SELECT so.q, a.asset_id FROM a JOIN so ON a.scope_id = so.scope_id AND abs(epoch_us(a.ts) - epoch_us(so.ts)) <= 7200000000),
e AS (SELECT q, asset_id FROM (SELECT x.q, a.asset_id, row_number() OVER (PARTITION BY x.q, a.event_id ORDER BY a.asset_id) AS n FROM a JOIN (SELECT DISTINCT q, event_id FROM so) x USING (event_id) WHERE (x.q, a.asset_id) NOT IN (SELECT (q, asset_id) FROM s)) WHERE n <= 4),
al AS (SELECT q, asset_id FROM (SELECT x.q, a.asset_id, row_number() OVER (PARTITION BY x.q, a.album ORDER BY a.asset_id) AS n FROM a JOIN (SELECT DISTINCT q, album FROM so) x USING (album) WHERE (x.q, a.asset_id) NOT IN (SELECT (q, asset_id) FROM s)) WHERE n <= 2),
n AS (SELECT * FROM (SELECT * FROM t UNION SELECT * FROM e UNION SELECT * FROM al) EXCEPT SELECT * FROM s), n2 AS (SELECT q, asset_id, row_number() OVER (PARTITION BY q ORDER BY asset_id) AS position FROM n),
n3 AS (SELECT q, asset_id, position + 80 AS position FROM n2 WHERE position <= 80 AND (q, asset_id) NOT IN (SELECT (q, asset_id) FROM p)), x AS ({_BEST.format(keys="q, asset_id, position", rows="n3")}),
items AS (SELECT q, asset_id, position, lv, score, p, d, 'recall' AS origin FROM p UNION ALL SELECT q, asset_id, position, lv, score, p, d, 'adjacency' FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY lv, score DESC, position) AS ordinal FROM items)"""


@query("kernel_multi", f"{_MULTI} SELECT q AS query_id, asset_id, CASE lv WHEN 1 THEN 'strong' ELSE 'approximate' END AS level, round(score, 9) AS score, origin, ordinal FROM o WHERE ordinal <= 80")
def kernel_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries through recall, ranking, conditions and adjacency."""
    assets = _assets(spark, sf_dir)
    found = kernel.multi(_hits(assets), assets.drop("value"), _observations(assets), _ASKED, top_k=80)
    return found.select("query_id", "asset_id", "level", F.round("score", 9).alias("score"), "origin", "ordinal")


@query("kernel_gaps", f"{_MULTI} SELECT qs.q AS query_id, c.condition FROM qs, (SELECT unnest(['media:click', 'person:u1', 'object:dog']) AS condition) c WHERE c.condition = 'object:dog' OR NOT EXISTS (SELECT 1 FROM o WHERE o.q = qs.q AND (c.condition = 'media:click' OR o.p = 2))")
def kernel_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditions that nothing found for a query meets directly."""
    assets = _assets(spark, sf_dir)
    found = kernel.multi(_hits(assets), assets.drop("value"), _observations(assets), _ASKED, top_k=80, all_relevant=True)
    return kernel.gaps(found, _ASKED, spark.createDataFrame([(1,), (2,), (3,)], "query_id int"))


@query("kernel_single", f"WITH {_DATA}, rows AS (SELECT asset_id FROM a), p AS ({_BEST.format(keys='asset_id', rows='rows')}) SELECT asset_id, CASE lv WHEN 1 THEN 'strong' ELSE 'approximate' END AS level, round(score, 9) AS score, row_number() OVER (ORDER BY lv, score DESC, asset_id) AS ordinal FROM p QUALIFY ordinal <= 100")
def kernel_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assets judged by their best observation; the hundred best (a top-k report)."""
    assets = _assets(spark, sf_dir).drop("value")
    return kernel.single(assets, _observations(assets), _ASKED, 100).select("asset_id", "level", F.round("score", 9).alias("score"), "ordinal")


@query("metadata_search", f"WITH {_DATA} SELECT asset_id, row_number() OVER (ORDER BY ts DESC, asset_id) AS ordinal FROM (SELECT DISTINCT a.asset_id, ts FROM a LEFT JOIN ob USING (asset_id) WHERE ts >= TIMESTAMP '2024-01-10' AND (media_type = 'click' OR person = 'u1')) QUALIFY ordinal <= 500")
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five hundred assets by time, kind or person (a top-k report), each once."""
    assets = _assets(spark, sf_dir)
    passes = (F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) & ((F.col("media_type") == "click") | F.coalesce(F.array_contains("people", "u1"), F.lit(False)))
    return kernel.metadata_search(assets, _observations(assets), passes)


@query(
    "metadata_channel",
    """WITH q AS (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08', NULL), (2, NULL, TIMESTAMP '2024-01-03', 'view'), (3, NULL, NULL, 'error')) AS v(query_id, a, b, media))
    SELECT query_id, event_id AS asset_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id) AS rank FROM events JOIN q ON (a IS NULL OR ts >= a) AND (b IS NULL OR ts < b) AND (media IS NULL OR event_type = media) QUALIFY rank <= 100""",
)
def metadata_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata channel of three queries: by time range, by range and kind, by kind."""
    queries = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-05', TIMESTAMP_NTZ '2024-01-08', CAST(NULL AS STRING)), (2, NULL, TIMESTAMP_NTZ '2024-01-03', 'view'), (3, NULL, NULL, 'error') AS v(query_id, start, end, media)")
    return retrieval.metadata_hits(catalog.assets(spark, sf_dir), queries).select("query_id", "asset_id", "rank")


@query(
    "metadata_channel_many",
    """WITH q AS (SELECT event_id AS query_id, ts - INTERVAL 6 HOUR AS a, CASE WHEN event_id % 300 = 0 THEN NULL ELSE ts + INTERVAL 6 HOUR END AS b, CASE WHEN event_id % 200 = 0 THEN NULL ELSE event_type END AS media FROM events WHERE event_id % 100 = 0)
    SELECT query_id, event_id AS asset_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id) AS rank FROM events JOIN q ON ts >= a AND (b IS NULL OR ts < b) AND (media IS NULL OR event_type = media) QUALIFY rank <= 20""",
)
def metadata_channel_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata channel of every hundredth event's half day, of its kind or of any; some are open to the end."""
    k, hours = F.col("event_id"), F.expr("INTERVAL '6' HOUR")
    end = F.when(k % 300 != 0, F.col("ts") + hours)
    queries = catalog.load(spark, sf_dir, "events").filter(k % 100 == 0).select(k.alias("query_id"), (F.col("ts") - hours).alias("start"), end.alias("end"), F.when(k % 200 != 0, F.col("event_type")).alias("media"))
    return retrieval.metadata_hits(catalog.assets(spark, sf_dir), queries, 20).select("query_id", "asset_id", "rank")


@query("text_channel", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id % 200 AS asset_id, max(list_inner_product(q.v, e.v)) AS s FROM q, e GROUP BY ALL) SELECT query_id, asset_id, round(s, 9) AS raw_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, asset_id) AS rank FROM s QUALIFY rank <= 10")
def text_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text channel of every hundredth vector over two spaces: an asset's best similarity in either (vectors are dealt to assets and spaces)."""
    rows = catalog.load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    spaces = [rows.filter(F.col("vec_id") % 2 == s).select((F.col("vec_id") % 200).alias("asset_id"), F.col("embedding").alias("vector")) for s in (0, 1)]
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = retrieval.vector_hits(spaces[0].unionAll(spaces[1]), queries, 10, "text")
    return found.select("query_id", "asset_id", F.round("raw_score", 9).alias("raw_score"), "rank")


@query(
    "contract_satisfaction",
    f"""WITH {_DATA}, j AS ({_JUDGED.format(keys="asset_id, scope_id", rows="(SELECT asset_id FROM a)")}),
    t AS (SELECT unnest([{{'c': 'media:click', 's': 2}}, {{'c': 'person:u1', 's': p}}, {{'c': 'object:dog', 's': d}}]) AS x FROM j), g AS (SELECT x.c AS c, max(x.s) AS s FROM t GROUP BY ALL)
    SELECT CASE WHEN count(*) FILTER (s = 0) = 0 THEN 'full_support' WHEN count(*) FILTER (s = 2) > 0 THEN 'partial_support' ELSE 'candidate_only' END AS satisfaction, CASE WHEN count(*) FILTER (s = 0) = 0 THEN 'full' WHEN count(*) FILTER (s = 2) > 0 THEN 'partial' ELSE 'limited' END AS answerability FROM g""",
)
def contract_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far all that was found satisfies a question, from its truth contract."""
    assets = _assets(spark, sf_dir).filter("media_type = 'click'")
    rows = assets.join(_observations(assets), "asset_id", "left").withColumn("people", F.coalesce("people", F.array().cast("array<string>")))
    return retrieval.satisfaction(retrieval.truth_contract(retrieval.evaluated(rows, _ASKED)))


@query("hard_conditions", f"WITH {_DATA} SELECT a.asset_id, obs_id, media_type <> 'click' OR coalesce(person, '') = 'u2' AS excluded FROM a LEFT JOIN ob USING (asset_id)")
def hard_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hard condition on the kind and a negated hard one on the person, on every asset and observation."""
    assets = _assets(spark, sf_dir)
    rows = assets.join(_observations(assets), "asset_id", "left").withColumn("people", F.coalesce("people", F.array().cast("array<string>")))
    asked = (Constraint("media", "click", HARD), Constraint("person", "u2", HARD, negated=True))
    return retrieval.evaluated(rows, asked).select("asset_id", "obs_id", "excluded")


@query("probe_decision", f"{_MULTI} SELECT q AS query_id, count(*) FILTER (c = 0) AS visual, count(*) FILTER (c = 1) AS entity, count(*) - count(DISTINCT asset_id) AS agreeing, CASE WHEN count(*) - count(DISTINCT asset_id) >= 2 THEN 'agreed' WHEN count(*) = 0 THEN 'nothing' ELSE 'scattered' END AS decision FROM h GROUP BY q")
def probe_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first probe of each query says: hits by channel, how many channels agree on, and a decision."""
    return retrieval.probe(_hits(_assets(spark, sf_dir)), ["visual", "entity"])


_PROBES = "p AS (SELECT user_id || ' ' || strftime(ts, '%Y-%m-%d') AS query_id, CASE event_type WHEN 'view' THEN 'visual' WHEN 'click' THEN 'lexical' WHEN 'purchase' THEN 'entity' END AS channel, event_id % 50 AS asset_id, value / 100 AS raw_score FROM events)"


@query(
    "probe_outcomes",
    f"""WITH {_PROBES}, h AS (SELECT * FROM p WHERE channel IS NOT NULL), g AS (SELECT query_id, list_sort(list(DISTINCT channel)) AS c, max(channel = 'lexical' AND raw_score >= 2.0) AS exact, max(channel = 'visual' AND raw_score >= 0.9) AS enough FROM h GROUP BY ALL),
    s AS (SELECT query_id, list_sort(list(asset_id)) AS shared FROM (SELECT query_id, asset_id, count(DISTINCT channel) AS n FROM h GROUP BY ALL) JOIN g USING (query_id) WHERE n = len(c) GROUP BY ALL), q AS (SELECT DISTINCT query_id FROM p),
    o AS (SELECT query_id, coalesce(len(c), 0)::INTEGER AS channels, shared, c, coalesce(exact, false) AS lexical_exact, CASE WHEN c IS NULL THEN 'none' WHEN len(c) >= 2 THEN 'channels' WHEN exact THEN 'exact' WHEN enough THEN 'score' ELSE 'weak' END AS reason FROM q LEFT JOIN g USING (query_id) LEFT JOIN s USING (query_id))
    SELECT query_id, CASE reason WHEN 'none' THEN 'no_match' WHEN 'weak' THEN 'clarify' ELSE 'upgrade' END AS decision, channels, coalesce(array_to_string(shared, ','), '') AS shared, lexical_exact, CASE WHEN shared IS NULL AND c IS NOT NULL THEN array_to_string(c, ',') ELSE '' END AS conflicts, reason FROM o""",
)
def probe_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's day (events as hits of three channels, values as scores) is worth a formal retrieval."""
    key = F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("query_id")
    kind = F.when(F.col("event_type") == "view", "visual").when(F.col("event_type") == "click", "lexical").when(F.col("event_type") == "purchase", "entity")
    rows = catalog.load(spark, sf_dir, "events").select(key, kind.alias("channel"), (F.col("event_id") % 50).alias("asset_id"), (F.col("value") / 100).alias("raw_score"))
    asked = rows.select("query_id").distinct().withColumn("text", F.lit("asked"))
    found = retrieval.probe_outcome(rows.filter("channel IS NOT NULL"), asked, {"visual": 0.9})
    return found.withColumn("shared", F.coalesce(F.array_join("shared", ","), F.lit(""))).withColumn("conflicts", F.array_join("conflicts", ","))


@query("overlap_scores", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_type = 'PROMO' THEN 1.0 WHEN contains(p_name, 'red') THEN 0.7 ELSE 0.0 END AS score FROM part")
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well sets of words agree: a shared word, a word in a word, or none."""
    words = F.array("p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("x"))
    return catalog.load(spark, sf_dir, "part").select("p_partkey", set_overlap(words, F.array(F.lit("PROMO"), F.lit("red"))).alias("score"))
