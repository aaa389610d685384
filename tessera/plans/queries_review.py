"""Reviews of entities, clusters, claims and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import review
from tessera.registry import query


@query(
    "taxonomy_labels",
    """SELECT label, count(*) AS n FROM (SELECT CASE WHEN lower(trim(event_type)) IN ('view', 'click') THEN upper(trim(event_type)) WHEN lower(trim(event_type)) = 'purchase' THEN 'BUY' WHEN contains(lower(trim(event_type)), 'err') THEN 'FAULT' ELSE 'OTHER' END AS label FROM events) GROUP BY label""",
)
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = review.taxonomy(F.col("event_type"), ["view", "click"], {"purchase": "BUY"}, [("err", "FAULT")])
    return catalog.load(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "classified_parts",
    """WITH w AS (SELECT p_partkey, trim(p_type) AS t, string_split(p_name, ' ') AS w, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS n FROM part),
    d AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE list_distinct(w) END AS g FROM w),
    c AS (SELECT p_partkey, t, w, n, CASE WHEN lower(t) IN ('small', 'medium', 'large') THEN upper(t) WHEN lower(t) = 'economy' THEN 'SMALL' WHEN contains(n, 'bolt') THEN 'MEDIUM' WHEN contains(n, 'widget') THEN 'LARGE' ELSE 'OTHER' END AS p FROM w)
    SELECT p_partkey, p AS primary_label,
      array_to_string(CASE WHEN p_partkey % 5 = 0 THEN list_filter(['round', 'flat'], lambda x: contains(array_to_string(w, ' '), CASE x WHEN 'round' THEN 'ring' ELSE 'plate' END)) ELSE list_filter(list_distinct(list_transform(w, lambda x: x)), lambda x: x IN ('small', 'large', 'cold')) END, ',') AS details,
      CASE WHEN lower(t) <> lower(p) THEN t || ';' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE array_to_string(list_filter(w, lambda x: x NOT IN ('small', 'large', 'cold')), ',') END AS raw FROM c""",
)
def classified_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in a vocabulary of sizes, by their type or their name; words of the name are details, of every fifth part only hinted at."""
    hinted = F.col("p_partkey") % 5 == 0
    words = F.when(~hinted, F.split("p_name", " "))
    found = review.classified(
        [F.col("p_type"), F.when(~hinted, F.col("p_name"))], words, F.col("p_name"), ["SMALL", "MEDIUM", "LARGE"], {"economy": "SMALL"}, [("bolt", "MEDIUM"), ("widget", "LARGE")], ["small", "large", "cold"], [("ring", "round"), ("plate", "flat")]
    )
    rows = catalog.load(spark, sf_dir, "part").select("p_partkey", F.col("p_type"), found.alias("f"))
    label = F.when(F.lower(F.trim("p_type")) != F.lower("f.primary"), 1).otherwise(0)
    rest = F.array_join(F.slice("f.raw", label + 1, F.size("f.raw") + 1), ",")
    raw = F.concat(F.when(label == 1, F.concat(F.get("f.raw", F.lit(0)), F.lit(";"))).otherwise(""), rest)
    return rows.select("p_partkey", F.col("f.primary").alias("primary_label"), F.array_join("f.details", ",").alias("details"), raw.alias("raw"))


@query("observation_entities", "WITH e AS (SELECT DISTINCT o_orderkey, 'priority' AS kind, trim(o_orderpriority) AS name FROM orders UNION SELECT DISTINCT o_orderkey, 'status', trim(o_orderstatus) FROM orders) SELECT kind, name, count(*) AS mentions FROM e WHERE name <> '' GROUP BY ALL")
def observation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that observations (orders) mention in two fields."""
    rows = catalog.load(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderpriority").alias("p"), F.array("o_orderstatus").alias("s"))
    return review.observation_graph(rows, "o_orderkey", {"priority": "p", "status": "s"})[0]


@query(
    "entity_cards",
    """WITH m AS (SELECT l_suppkey, count(*) AS mentions, max(l_shipdate) AS latest FROM lineitem GROUP BY l_suppkey),
    r AS (SELECT k, count(*) AS relations FROM (SELECT a AS k FROM (SELECT DISTINCT l_suppkey AS a, l_suppkey % 7 + 1 AS b FROM lineitem) UNION ALL SELECT b FROM (SELECT DISTINCT l_suppkey AS a, l_suppkey % 7 + 1 AS b FROM lineitem)) GROUP BY k)
    SELECT s_suppkey AS l_suppkey, coalesce(mentions, 0) AS mentions, coalesce(relations, 0) AS relations, strftime(latest, '%Y-%m-%d') AS latest FROM supplier LEFT JOIN m ON l_suppkey = s_suppkey LEFT JOIN r ON k = s_suppkey""",
)
def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = catalog.load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate")
    edges = lines.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") % 7 + 1).alias("b")).distinct()
    cards = review.entity_cards(catalog.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), lines, edges, "l_suppkey", "l_shipdate")
    return cards.withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query(
    "retained_cluster_ids",
    """WITH n AS (SELECT vec_id, vec_id % 12 AS cluster FROM embeddings), o AS (SELECT vec_id, vec_id % 12 * 10 + (vec_id // 12 % 5 = 0)::INTEGER AS old_cluster FROM embeddings WHERE vec_id % 3 <> 0),
    s AS (SELECT cluster, old_cluster, count(*) AS c FROM n JOIN o USING (vec_id) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, old_cluster) AS x, row_number() OVER (PARTITION BY old_cluster ORDER BY c DESC, cluster) AS y FROM s)
    SELECT d.cluster, k.old_cluster FROM (SELECT DISTINCT cluster FROM n) d LEFT JOIN k ON k.cluster = d.cluster AND x = 1 AND y = 1""",
)
def retained_cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which old id each new cluster keeps."""
    rows = catalog.load(spark, sf_dir, "embeddings").select("vec_id")
    new = rows.withColumn("cluster", F.col("vec_id") % 12)
    old = rows.filter("vec_id % 3 <> 0").withColumn("cluster", F.col("vec_id") % 12 * 10 + (F.floor(F.col("vec_id") / 12) % 5 == 0).cast("int"))
    return review.retained_ids(new, old, "vec_id", "cluster")


@query(
    "cluster_diagnostics",
    """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT label, d, sum(x) AS s FROM e GROUP BY ALL), q AS (SELECT label, sum(s * s) AS sq FROM s GROUP BY ALL),
    n AS (SELECT label, count(*) AS n, count(DISTINCT vec_id // 2) AS a FROM embeddings GROUP BY ALL)
    SELECT label, n, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE '11+' END AS size_bucket, round(CASE WHEN n > 1 THEN (sq - n) / (n * (n - 1)) END, 6) AS within, n - a AS conflicts FROM n JOIN q USING (label)""",
)
def cluster_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean similarity and repeated assets of each label's vectors."""
    rows = catalog.load(spark, sf_dir, "embeddings").withColumn("asset", F.floor(F.col("vec_id") / 2))
    return review.cluster_diagnostics(rows, "label", "embedding", "asset").withColumn("within", F.round("within", 6))


@query("primary_labels", "SELECT o_custkey, arg_max(o_orderstatus, (o_totalprice, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def primary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each group's foremost member."""
    return review.primary(catalog.load(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice", "o_orderkey"], "o_orderstatus")


@query(
    "claim_support",
    """WITH c AS (SELECT conv_id AS claim_id, unnest([conv_id, conv_id + 100000, conv_id * 3]) AS evidence_id FROM (SELECT DISTINCT conv_id FROM conversations)),
    e AS (SELECT doc_id AS evidence_id, lang = 'en' AND doc_id % 2 = 0 AS visible FROM documents),
    t AS (SELECT claim_id, bool_or(coalesce(visible, false)) AS v, count(visible) AS k FROM c LEFT JOIN e USING (evidence_id) GROUP BY claim_id)
    SELECT claim_id, CASE WHEN v THEN 'supported' WHEN k > 0 THEN 'hidden' ELSE 'unsupported' END AS support FROM t""",
)
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by whether evidence for them may be seen."""
    claims = catalog.load(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("claim_id"), F.array(F.col("conv_id"), F.col("conv_id") + 100000, F.col("conv_id") * 3).alias("candidates"))
    evidence = catalog.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "lang")
    return review.verified(claims, evidence, F.col("lang") == "en", F.col("evidence_id") % 2 == 0)


@query("ledger_problems", "SELECT conv_id AS run_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(list(role), x))), ',') AS missing_roles, count(*) FILTER (turn % 5 <> 0) AS other_model, count(*) FILTER (length(text) > 1500) AS degraded FROM conversations GROUP BY conv_id")
def ledger_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing roles, wrong models and degraded calls of each run."""
    runs = catalog.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "role", F.when(F.col("turn") % 5 == 0, "m1").otherwise("m2").alias("model"), (F.length("text") > 1500).alias("degraded"))
    return review.ledger_problems(runs, ["assistant", "system", "user"], "m1")


@query("slot_acceptance", "SELECT round(avg(CASE WHEN n_chars > 100 THEN 1.0 ELSE 0.0 END), 9) AS accepted, round(avg(CASE WHEN lang IS NOT DISTINCT FROM 'en' THEN 1.0 ELSE 0.0 END), 9) AS lang, round(avg(CASE WHEN source IS NOT DISTINCT FROM 'src' || (doc_id % 20)::VARCHAR THEN 1.0 ELSE 0.0 END), 9) AS source FROM documents")
def slot_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.load(spark, sf_dir, "documents").select((F.col("n_chars") > 100).alias("parsed"), "lang", "source", F.lit("en").alias("expected_lang"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("expected_source"))
    found = review.acceptance(rows, "parsed", ["lang", "source"])
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    "evidence_paths",
    """SELECT entity, count(DISTINCT CASE WHEN p = 'orders' THEN ev END) AS orders, count(DISTINCT CASE WHEN p = 'returns' THEN ev END) AS returns, count(DISTINCT ev) AS evidence
    FROM (SELECT l_suppkey AS entity, l_orderkey AS ev, 'orders' AS p FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey, 'returns' FROM lineitem WHERE l_returnflag = 'R') GROUP BY entity""",
)
def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence of each entity over two paths and over both."""
    lines = catalog.load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag")
    return review.evidence_paths({"orders": lines, "returns": lines.filter("l_returnflag = 'R'")}, "l_suppkey", "l_orderkey")
