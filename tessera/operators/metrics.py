"""Evaluation: ranked lists, clusterings, latencies, attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.orderstats import nearest_rank, order_statistics, rounded_index


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """One row of macro means over the queries of truth: recall@k, MRR (of the first hit; 0 without one), precision@5.

    ranked: query_id, asset_id, rank. truth: query_id, asset_id.
    """
    wanted = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = ranked.join(truth, ["query_id", "asset_id"], "left_semi")
    upto = lambda k: F.coalesce(F.sum((F.col("rank") <= k).cast("long")), F.lit(0))
    per = wanted.join(hits, "query_id", "left").groupBy("query_id", "relevant").agg(*[upto(k).alias(f"h{k}") for k in ks], upto(5).alias("p5"), F.min("rank").alias("first"))
    means = [F.avg(F.col(f"h{k}") / F.col("relevant")).alias(f"recall_at_{k}") for k in ks]
    return per.agg(F.count(F.lit(1)).alias("queries"), *means, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("p5") / 5).alias("precision_at_5"))


def hit_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Hit@k of the first hit over all queries, MRR over queries with a hit only."""
    first = truth.select("query_id").distinct().join(ranked.join(truth, ["query_id", "asset_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    return first.agg(*[F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in ks], F.avg(1 / F.col("first")).alias("mrr_of_hits"))


def separation_auc(scores: DataFrame) -> DataFrame:
    """Share of a query's (target, other) pairs in which the target scores higher, ties one half.

    scores: query_id, score, is_target. By ranks within the query, so no pair is formed: U = sum of target ranks less the
    least they can be.
    """
    score = W.partitionBy("query_id").orderBy("score")
    ranked = scores.withColumn("__lo", F.rank().over(score)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("query_id", "score")))
    ranked = ranked.withColumn("__mid", F.col("__lo") + (F.col("__n") - 1) / 2)
    per = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("is_target"), F.col("__mid"))).alias("r"), F.sum(F.col("is_target").cast("long")).alias("t"), F.sum((~F.col("is_target")).cast("long")).alias("o"))
    return per.agg(((F.sum(F.col("r") - F.col("t") * (F.col("t") + 1) / 2)) / F.sum(F.col("t") * F.col("o"))).alias("auc"))


def pairwise(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering, from the contingency table: no pairs are formed."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = labels.groupBy(truth, found).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs(F.col("n")).alias("tp"))
    by = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias(name))
    single = cells.groupBy(found).agg(F.sum("n").alias("n")).agg(F.avg((F.col("n") == 1).cast("double")).alias("singleton_ratio"))
    row = both.crossJoin(by(found, "p")).crossJoin(by(truth, "t")).crossJoin(single)  # four single rows
    p, r = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    row = row.withColumn("precision", p).withColumn("recall", r)
    return row.select("precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"), "singleton_ratio")


def split_merged(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """How many true groups are split, and how many found ones merge several."""
    over = lambda a, b, name: labels.groupBy(a).agg(F.countDistinct(b).alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias(name))
    return over(truth, found, "split_groups").crossJoin(over(found, truth, "merged_groups"))


def micro(rows: DataFrame, tp: str, fp: str, fn: str) -> DataFrame:
    """Micro precision, recall and F1 of counted rows."""
    s = rows.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Layers in the order in which a failure is looked for, offline and in a running service.
OFFLINE = ("retrieval", "verification", "observation", "time", "structure", "grounding", "judge", "delivery")
ONLINE = ("grounding", "retrieval", "verification", "observation", "time", "structure", "judge")


def first_failure(rows: DataFrame, layers: tuple[str, ...] = OFFLINE) -> DataFrame:
    """rows with the first layer, in order, whose column says `fail`; `none` where none does."""
    return rows.withColumn("failed_layer", F.coalesce(*[F.when(F.col(x) == "fail", F.lit(x)) for x in layers], F.lit("none")))


def win_rate(votes: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Share of votes in which ours is no worse (ties count as wins), mean of ours, and whether the gate of 0.8 is passed."""
    s = votes.agg(F.avg((F.col(ours) >= F.col(theirs)).cast("double")).alias("win_rate"), F.avg(ours).alias("helpfulness"))
    return s.withColumn("passed", F.col("win_rate") >= 0.8)


def readiness(n: Column, support_rate: Column, false_confident_rate: Column, fewest: int = 20, unsafe: float = 0.05, ready: float = 0.8) -> Column:
    return F.when(n < fewest, "insufficient").when(false_confident_rate > unsafe, "unsafe").when(support_rate >= ready, "ready").otherwise("limited")


def held_out_split(cases: DataFrame, key: str, category: str, n: int, seed: int = 42) -> DataFrame:
    """cases with hidden: one of each category, and more by hash order until there are n."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    first = F.row_number().over(W.partitionBy(category).orderBy(order, key)) == 1
    marked = cases.withColumn("__f", first).withColumn("__h", order)
    chosen = marked.orderBy(F.desc("__f"), "__h", key).limit(n).select(F.col(key).alias("__k"))
    return marked.join(chosen, marked[key] == chosen["__k"], "left").withColumn("hidden", F.col("__k").isNotNull()).drop("__f", "__h", "__k")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def net_latency(wall: Column, judged: list[Column]) -> Column:
    """Wall time less the judges' times, 0 at least; null if one of those is unknown."""
    net = wall - reduce(lambda a, b: a + b, judged)
    return F.when(net.isNotNull(), F.greatest(F.lit(0.0), net))


def multi_target_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """retrieval_metrics with all_relevant_at_20: the share of queries all of whose targets are among the first 20."""
    wanted = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = ranked.join(truth, ["query_id", "asset_id"], "left_semi").filter("rank <= 20").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    whole = wanted.join(hits, "query_id", "left").agg(F.avg((F.coalesce("found", F.lit(0)) == F.col("relevant")).cast("double")).alias("all_relevant_at_20"))
    return retrieval_metrics(ranked, truth, ks).crossJoin(whole)  # two single rows


def item_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per question the precision, recall and F1 of the predicted items (repeats count once). Both: question_id, item."""
    p, t = predicted.select("question_id", "item").distinct().withColumn("p", F.lit(1)), truth.select("question_id", "item").distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["question_id", "item"], "full_outer").groupBy("question_id").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("t").alias("wanted"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    both = both.withColumn("precision", safe(F.col("tp"), F.col("predicted"))).withColumn("recall", safe(F.col("tp"), F.col("wanted")))
    return both.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ann_recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact k nearest that an index found, over all queries. Both: query_id, vec_id, rank."""
    wanted = exact.filter(F.col("rank") <= k).select("query_id", "vec_id").withColumn("w", F.lit(1))
    got = found.filter(F.col("rank") <= k).select("query_id", "vec_id").withColumn("g", F.lit(1))
    return wanted.join(got, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.avg(F.col("g").isNotNull().cast("double")).alias("recall"))


def primary_face_scores(faces: DataFrame, truth: DataFrame, order: list[str]) -> DataFrame:
    """Pairwise scores of the foremost face of each labelled image, and coverage. A missing one is a cluster of its own.

    faces: image_id, cluster_id and what they are ordered by. truth: image_id, identity.
    """
    best = faces.groupBy("image_id").agg(F.max(F.struct(*order, "cluster_id"))["cluster_id"].alias("c"), F.count(F.lit(1)).alias("n"))
    rows = truth.join(best, "image_id", "left").withColumn("found", F.coalesce(F.col("c").cast("string"), F.concat(F.lit("missing:"), F.col("image_id").cast("string"))))
    cover = rows.agg(F.avg(F.col("c").isNotNull().cast("double")).alias("coverage"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_faces"))
    return pairwise(rows, "identity", "found").crossJoin(cover)  # two single rows


def macro_recall(ranked: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall@k as the mean over queries of the share of their targets that are found. targets: query_id, asset_id."""
    return retrieval_metrics(ranked, targets, ks).select("queries", *[f"recall_at_{k}" for k in ks])


def timing_summary(rows: DataFrame, name: str, seconds: str) -> DataFrame:
    """Per name: count, sum, mean, p50 and p95 (of index round((n - 1) q), half to even) and maximum."""
    base = rows.groupBy(name).agg(F.count(seconds).alias("count"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max"))
    order = order_statistics(rows, [name], seconds, {"p50": (rounded_index, 0.5), "p95": (rounded_index, 0.95)})
    return base.join(order.select(name, "p50", "p95"), name)


def run_summary(rows: DataFrame, correct: str, tokens: str, seconds: str) -> DataFrame:
    """One row about a run: questions, accuracy, mean seconds, mean, 95th percentile (nearest rank) and most tokens."""
    base = rows.agg(F.count(F.lit(1)).alias("questions"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(seconds).alias("mean_seconds"), F.avg(tokens).alias("mean_tokens"), F.max(tokens).alias("most_tokens"))
    p95 = order_statistics(rows.withColumn("__all", F.lit(1)), ["__all"], tokens, {"p95_tokens": (nearest_rank, 0.95)}).select("p95_tokens")
    return base.crossJoin(p95)  # two single rows


def capability_summary(rows: DataFrame, capability: str, tp: str, fp: str, fn: str, answered: str, seconds: str) -> DataFrame:
    """Per capability: micro precision, recall and F1, the share of answered questions, and mean and slowest seconds."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = rows.groupBy(capability).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.avg(F.col(answered).cast("double")).alias("answered_rate"), F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("max_seconds"))
    s = s.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
