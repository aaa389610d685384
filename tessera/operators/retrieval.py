"""Retrieval: channels of hits, ranking and fusion, conditions and evidence levels.

A hits DataFrame has query_id, channel, asset_id, raw_score and rank (from 1). Channels are unioned once and ranked by
windows per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import contains
from tessera.functions.vector import dot, rrf
from tessera.operators.joins import micros
from tessera.plans.spec import HARD, SEMANTIC, Constraint

#: Channels in their order, with the weights of late fusion.
CHANNELS = {"metadata": 0.5, "entity": 1.0, "lexical": 1.0, "visual": 1.5, "text": 1.0, "adjacency": 0.5}
_ORDER = {c: i for i, c in enumerate(CHANNELS)}

Retriever = Callable[..., DataFrame]
RETRIEVERS: dict[str, Retriever] = {}


def retriever(name: str) -> Callable[[Retriever], Retriever]:
    """Registers a channel: a function that returns hits."""

    def add(f: Retriever) -> Retriever:
        RETRIEVERS[name] = f
        return f

    return add


def _ranked(rows: DataFrame, channel: str, order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.lit(channel).alias("channel"), "asset_id", F.col("raw_score").cast("double").alias("raw_score"), "rank")


#: Vectors asked for are broadcast up to so many; more of them meet the others in blocks.
MAX_BROADCAST_QUERIES = 10_000

#: Scores that a task forms at once.
MAX_SCORES = 1 << 21

#: So many queries of the metadata channel look at all assets; more of them go to the places of their answers.
MAX_SCANNING_QUERIES = 100


@retriever("metadata")
def metadata_hits(assets: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """Assets in the query's time range (start, end; null is open) and media (null is any), newest first. A null time passes."""
    if queries.limit(MAX_SCANNING_QUERIES + 1).count() > MAX_SCANNING_QUERIES:
        rows = _newest_by_places(assets, queries, k)
    else:
        inside = (F.col("ts").isNull()) | ((F.col("start").isNull() | (F.col("ts") >= F.col("start"))) & (F.col("end").isNull() | (F.col("ts") < F.col("end"))))
        rows = assets.join(F.broadcast(queries), inside & (F.col("media").isNull() | (F.col("media_type") == F.col("media"))))
    return _ranked(rows.withColumn("raw_score", F.lit(0.0)), "metadata", [F.desc_nulls_last("ts"), F.asc("asset_id")], k)


_HOUR = 3_600_000_000


def _newest_by_places(assets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, asset_id and ts: of each query's assets at least the k newest, without comparing all assets with all queries.

    Assets of a media type, and those of any, are numbered from the newest on: by hour, and before each hour the count of the
    newer ones. What a query wants starts at the number of assets that aren't before its end and takes k places from there, which
    lie in two runs of k: an equi-join. Assets without a time come after all others, so the first k of them do for every query.
    """
    media = F.explode(F.array(F.lit(""), F.concat(F.lit("="), "media_type"))).alias("__m")  # any, and the asset's own
    held = assets.select("asset_id", "ts", media).filter("__m IS NOT NULL")
    asked = queries.select("query_id", "start", "end", F.when(F.col("media").isNull(), "").otherwise(F.concat(F.lit("="), "media")).alias("__m"))
    t, hour = micros("__t"), F.floor(micros("__t") / _HOUR).alias("__hour")
    own = held.filter("ts IS NOT NULL").withColumn("__t", F.col("ts")).select("__m", t.alias("__t"), hour, F.lit(0).alias("__side"), "asset_id", "ts", F.lit(None).cast(kind(queries, "query_id")).alias("query_id"), F.lit(None).cast(kind(queries, "start")).alias("start"))
    ends = asked.filter("`end` IS NOT NULL").withColumn("__t", F.col("end"))
    ends = ends.select("__m", t.alias("__t"), hour, F.lit(1).alias("__side"), F.lit(None).cast(kind(assets, "asset_id")).alias("asset_id"), F.lit(None).cast(kind(assets, "ts")).alias("ts"), "query_id", "start")
    both = own.unionByName(ends)
    hours = both.groupBy("__m", "__hour").agg(F.sum(1 - F.col("__side")).alias("n"))
    newer = F.sum("n").over(W.partitionBy("__m").orderBy(F.desc("__hour")).rowsBetween(W.unboundedPreceding, -1))
    newer = hours.select("__m", "__hour", F.coalesce(newer, F.lit(0)).alias("__newer"))
    order = W.partitionBy("__m", "__hour").orderBy(F.desc("__t"), "__side", "asset_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = both.withColumn("__n", F.sum(1 - F.col("__side")).over(order)).join(newer, ["__m", "__hour"])
    at = F.col("__newer") + F.col("__n") + F.col("__side") - 1  # from 0
    placed = placed.withColumn("__at", at)
    numbered = placed.filter("__side = 0").select("__m", F.floor(F.col("__at") / k).alias("__run"), "__at", "asset_id", "ts")
    begins = placed.filter("__side = 1").select("query_id", "__m", "start", F.col("__at").alias("__from"))
    begins = begins.unionByName(asked.filter("`end` IS NULL").select("query_id", "__m", "start", F.lit(0).cast("long").alias("__from")))
    run = F.floor(F.col("__from") / k)
    wanted = begins.withColumn("__run", F.explode(F.array(run, run + 1)))
    timed = wanted.join(numbered, ["__m", "__run"]).filter((F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__from") + k) & (F.col("start").isNull() | (F.col("ts") >= F.col("start"))))
    first = F.row_number().over(W.partitionBy("__m").orderBy("asset_id"))
    undated = held.filter("ts IS NULL").withColumn("__n", first).filter(F.col("__n") <= k)
    untimed = asked.select("query_id", "__m").join(undated, "__m")
    return timed.select("query_id", "asset_id", "ts").unionByName(untimed.select("query_id", "asset_id", "ts"))


@retriever("entity")
def entity_hits(mentions: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """Assets that mention any entity of the query (query_id, entity_id), in order of asset."""
    # An entity's first k assets are all that any query can want of it.
    first = F.row_number().over(W.partitionBy("entity_id").orderBy("asset_id"))
    few = mentions.select("entity_id", "asset_id").distinct().withColumn("__n", first).filter(F.col("__n") <= k).drop("__n")
    rows = few.join(queries, "entity_id").select("query_id", "asset_id").distinct().withColumn("raw_score", F.lit(1.0))
    return _ranked(rows, "entity", [F.asc("asset_id")], k)


@retriever("lexical")
def lexical_channel(lexical: DataFrame, k: int = 100) -> DataFrame:
    return _ranked(lexical.drop("rank"), "lexical", [F.desc("raw_score"), F.asc("asset_id")], k)


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def edge_places(scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k best finite scores, and of all that tie with the last of them (k None: of all)."""
    if not scores.size:
        return np.zeros(0, int), np.zeros(0, int)
    n = scores.shape[1]
    take = n if k is None else min(k, n)
    edge = np.partition(scores, n - take, axis=1)[:, n - take, None]
    return np.nonzero((scores >= edge) & np.isfinite(scores))


def tiles(queries: int, vectors: int) -> Iterator[slice]:
    """Stretches of queries of which each has MAX_SCORES scores at most, or is one query."""
    step = max(1, MAX_SCORES // max(vectors, 1))
    return (slice(s, min(s + step, queries)) for s in range(0, queries, step))


def _scored(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """query_id, asset_id and raw_score: of every Arrow batch each query's k best (or all), an asset by its best vector.

    The queries, counted and at most MAX_BROADCAST_QUERIES, are one matrix that every batch is multiplied with.
    """
    rows = queries.select("query_id", "q").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["q"]), []).append(r)
    known = vectors.sparkSession.sparkContext.broadcast({n: ([r["query_id"] for r in rs], np.array([r["q"] for r in rs], float)) for n, rs in by_size.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("asset_id", kind="stable", ignore_index=True)
            sizes = b["vector"].map(len)
            for n in sizes.unique():
                if n not in known.value:
                    continue
                ids, q = known.value[n]
                own = b[sizes == n]
                assets = own["asset_id"].to_numpy()
                first = np.flatnonzero(np.r_[True, assets[1:] != assets[:-1]])
                x = np.stack(own["vector"].to_numpy()).astype(float).T
                for some in tiles(len(ids), len(own)):
                    scores = np.maximum.reduceat(q[some] @ x, first, axis=1)
                    at, place = edge_places(scores, k)
                    yield pd.DataFrame({"query_id": [ids[some.start + i] for i in at], "asset_id": assets[first][place], "raw_score": scores[at, place]})

    return vectors.select("asset_id", "vector").mapInPandas(run, f"query_id {kind(queries, 'query_id')}, asset_id {kind(vectors, 'asset_id')}, raw_score double")


#: Sides of a block of vectors and queries that one task scores.
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 4096
#: Of one from which all scores come out.
WHOLE_BLOCK = 2048, 1024


def by_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int | None, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]) -> DataFrame:
    """query_id, asset_id and raw_score of queries and vectors with equal keys, in blocks of bounded size, however many a key has.

    Blocks are cut by asset, so all vectors of one asset are in the same.

    score: of some of a block's queries and its vectors a matrix (queries x vectors); -inf is no pair. Of a block each query's k best come
    out (None: all).
    """
    most = (BLOCK_VECTORS, BLOCK_QUERIES) if k else WHOLE_BLOCK
    count = lambda rows, size, name: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sides = count(vectors, most[0], "__blocks").join(count(queries, most[1], "__batches"), keys)
    sides = F.broadcast(sides)  # a row a list, or a length of vectors
    left = queries.join(sides, keys).withColumn("__batch", F.pmod(F.xxhash64("query_id"), "__batches")).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    right = vectors.join(sides, keys).withColumn("__block", F.pmod(F.xxhash64("asset_id"), "__blocks")).withColumn("__batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__batches") - 1)))
    by = [*keys, "__batch", "__block"]

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "asset_id": v["asset_id"][:0], "raw_score": []})
        v = v.sort_values("asset_id", kind="stable", ignore_index=True)
        assets = v["asset_id"].to_numpy()
        first = np.flatnonzero(np.r_[True, assets[1:] != assets[:-1]])
        found = []
        for part in tiles(len(q), len(v)):
            some = q[part].reset_index(drop=True)
            scores = np.maximum.reduceat(score(some, v), first, axis=1)  # an asset by its best vector
            i, j = edge_places(scores, k)
            found.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[i], "asset_id": assets[first][j], "raw_score": scores[i, j]}))
        return pd.concat(found, ignore_index=True)

    # Named anew, as both sides may come from one table.
    left, right = [df.select(*[F.col(c).alias(c) for c in df.columns if c not in ("__blocks", "__batches")]) for df in (left, right)]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, f"query_id {kind(queries, 'query_id')}, asset_id {kind(vectors, 'asset_id')}, raw_score double")


def dots(q: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
    return np.stack(q["q"].to_numpy()).astype(float) @ np.stack(v["vector"].to_numpy()).astype(float).T


def _dealt(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """_scored() for any number of queries: vectors and queries of one length meet in blocks."""
    size = lambda c: F.size(c).alias("__size")
    left = queries.select("query_id", "q", size("q")).filter("__size > 0")
    return by_blocks(vectors.select("asset_id", "vector", size("vector")).filter("__size > 0"), left, ["__size"], k, dots)


def all_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, asset_id and raw_score of every vector for every query of its length."""
    return (_scored if queries.count() <= MAX_BROADCAST_QUERIES else _dealt)(vectors, queries, None)


@retriever("visual")
def vector_hits(vectors: DataFrame, queries: DataFrame, k: int = 10, channel: str = "visual", strategy: str = "exact") -> DataFrame:
    """Cosine top k for queries (query_id, q).

    Strategy exact: of unit vectors (asset_id, vector; several of an asset count with the best), all of them. Strategy index:
    vectors is a VectorIndex, of which each query visits a part; queries may have a scope_id.
    """
    if strategy == "index":
        return _ranked(vectors.search(queries, k).drop("rank"), channel, [F.desc("raw_score"), F.asc("asset_id")], k)
    if strategy != "exact":
        raise ValueError(f"unknown strategy {strategy}")
    few = queries.count() <= MAX_BROADCAST_QUERIES
    scored = _scored(vectors, queries, k) if few else _dealt(vectors, queries, k)
    return _ranked(scored.groupBy("query_id", "asset_id").agg(F.max("raw_score").alias("raw_score")), channel, [F.desc("raw_score"), F.asc("asset_id")], k)


@retriever("text")
def text_hits(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vector_hits over the text spaces: an asset's vectors of all of them count with the best."""
    return vector_hits(vectors, queries, k, "text")


def union_hits(*channels: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, channels)


def _place(channel: Column) -> Column:
    return reduce(lambda acc, c: F.when(channel == c, _ORDER[c]).otherwise(acc), CHANNELS, F.lit(len(CHANNELS)))


def _weight(channel: Column) -> Column:
    return reduce(lambda acc, c: F.when(channel == c, CHANNELS[c]).otherwise(acc), CHANNELS, F.lit(1.0))


def rank_visual_only(hits: DataFrame) -> DataFrame:
    return hits.filter("channel = 'visual'").select("query_id", "asset_id", F.col("rank").alias("position"))


def rank_backbone(hits: DataFrame) -> DataFrame:
    """The visual order first, then what other channels add, channel by channel; an asset counts where it comes first."""
    first = hits.groupBy("query_id", "asset_id").agg(F.min(F.struct((F.col("channel") != "visual").alias("other"), _place(F.col("channel")).alias("c"), "rank")).alias("at"))
    return first.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("at", "asset_id"))).select("query_id", "asset_id", "position")


def rank_late_fusion(hits: DataFrame) -> DataFrame:
    """By the weighted sum of each channel's score over the channel's highest."""
    top = F.max("raw_score").over(W.partitionBy("query_id", "channel"))
    share = F.when(top > 0, F.col("raw_score") / top).otherwise(F.lit(0.0))
    scored = hits.withColumn("s", share * _weight(F.col("channel"))).groupBy("query_id", "asset_id").agg(F.sum("s").alias("score"))
    return scored.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "asset_id")))


def fuse(hits: DataFrame, k: int = 60, anchors: DataFrame | None = None, boost: float = 1.0) -> DataFrame:
    """By weighted reciprocal rank; anchored assets (query_id, asset_id) get the boost."""
    scored = hits.groupBy("query_id", "asset_id").agg(F.sum(rrf(F.col("rank"), _weight(F.col("channel")), k)).alias("score"), F.min(F.struct(_place(F.col("channel")), "channel"))["channel"].alias("first_channel"))
    if anchors is not None:
        marked = anchors.select("query_id", "asset_id", F.lit(boost).alias("__b"))
        scored = scored.join(marked, ["query_id", "asset_id"], "left").withColumn("score", F.col("score") + F.coalesce("__b", F.lit(0.0))).drop("__b")
    return scored.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "asset_id")))


def agreement(hits: DataFrame, channels: int) -> DataFrame:
    """Assets that at least so many channels found."""
    return hits.groupBy("query_id", "asset_id").agg(F.countDistinct("channel").alias("n")).filter(F.col("n") >= channels)


# --- conditions ------------------------------------------------------------------------------------------------------

# Sources whose word is enough (a match from another one is only possible), and dimensions of which what
# wasn't seen may still be there.
PROVEN = ("asset_metadata", "observation_field_exact", "confirmed_bridge", "entity_bridge_confirmed", "subject_binding")
OPEN_WORLD = ("clothing", "object", "ocr", "activity", "scene")


def condition(c: Constraint) -> Column:
    """struct<status, source>: matched, possible, unknown or contradicted. Rows have ts, media_type, place, people, text."""
    status = lambda s, src: F.struct(F.lit(s).alias("status"), F.lit(src).alias("source"))
    if c.dimension == "time":
        start, end = c.value
        inside = (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))
        return F.when(inside, status("matched", "asset_metadata")).otherwise(status("contradicted", "asset_metadata"))
    if c.dimension == "media":
        return F.when(F.col("media_type") == c.value, status("matched", "asset_metadata")).otherwise(status("contradicted", "asset_metadata"))
    if c.dimension == "place":
        exact = F.lower("place") == str(c.value).lower()
        return F.when(F.col("place").isNull(), status("unknown", "none")).when(exact, status("matched", "observation_field_exact")).when(contains(F.col("place"), F.lit(c.value)), status("matched", "observation_text")).otherwise(status("contradicted", "observation_field_exact"))
    if c.dimension == "person":
        return F.when(F.array_contains("people", c.value), status("matched", "entity_bridge_confirmed")).when(contains(F.col("text"), F.lit(c.value)), status("matched", "observation_text")).otherwise(status("unknown", "none"))
    # Open world: what wasn't seen may still be there.
    return F.when(contains(F.col("text"), F.lit(c.value)), status("matched", "observation_text")).otherwise(status("unknown", "none"))


def evaluated(rows: DataFrame, constraints: tuple[Constraint, ...]) -> DataFrame:
    """rows with conditions (map of key to status), excluded, level and score.

    A negated constraint that holds counts as satisfied (unmatched is what it asks for), so it doesn't lower the level.
    """
    keys, states, excluded = [], [], F.lit(False)
    for c in {c.key: c for c in constraints}.values():
        raw = condition(c)
        status = F.when((raw["status"] == "matched") & ~raw["source"].isin(*PROVEN), "possible").otherwise(raw["status"])
        if c.negated:
            shown = F.when(status == "matched", "contradicted").when(status == "contradicted", "matched").otherwise(status)
        else:
            shown = status
        keys.append(F.lit(c.key))
        states.append(shown)
        if c.strictness == HARD:
            excluded = excluded | ((status == "matched") if c.negated else (status != "matched"))
        elif c.strictness == SEMANTIC:
            excluded = excluded | (shown == "contradicted")
    if not keys:
        return rows.withColumn("conditions", F.create_map().cast("map<string,string>")).withColumn("excluded", F.lit(False)).withColumn("level", F.lit("exact")).withColumn("score", F.lit(0.0))
    out = rows.withColumn("conditions", F.map_from_arrays(F.array(*keys), F.array(*states))).withColumn("excluded", excluded)
    values = F.map_values("conditions")
    weak = F.filter(values, lambda s: s != "matched")
    level = F.when(F.size(weak) == 0, "exact").when(F.forall(weak, lambda s: s == "possible"), "strong").otherwise("approximate")
    matched = F.size(F.filter(values, lambda s: s == "matched"))
    return out.withColumn("level", level).withColumn("score", matched / F.lit(max(1, len(keys))))


def truth_contract(items: DataFrame) -> DataFrame:
    """Per condition how many items say what, and its verdict: confirmed, supported, contradicted or unknown."""
    each = items.select(F.explode("conditions").alias("condition", "status"))
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    tally = each.groupBy("condition").agg(n("matched").alias("confirmed"), n("possible").alias("supported"), n("contradicted").alias("contradicted"), n("unknown").alias("unknown"))
    verdict = F.when(F.col("confirmed") > 0, "confirmed").when(F.col("supported") > 0, "supported").when(F.col("contradicted") > 0, "contradicted").otherwise("unknown")
    return tally.withColumn("verdict", verdict)


def satisfaction(contract: DataFrame) -> DataFrame:
    """One row: satisfaction and answerability of a truth contract."""
    n = lambda *v: F.sum(F.col("verdict").isin(*v).cast("long"))
    s = contract.agg(F.count(F.lit(1)).alias("all"), n("confirmed").alias("confirmed"), n("unknown", "contradicted").alias("open"))
    s = s.withColumn("satisfaction", F.when(F.col("all") == 0, "candidate_only").when(F.col("open") == 0, "full_support").when(F.col("confirmed") > 0, "partial_support").otherwise("candidate_only"))
    return s.select("satisfaction", F.when(F.col("satisfaction") == "full_support", "full").when(F.col("confirmed") > 0, "partial").otherwise("limited").alias("answerability"))


# --- expansion -------------------------------------------------------------------------------------------------------


def time_neighbours(assets: DataFrame, seeds: DataFrame, minutes: int = 120) -> DataFrame:
    """Assets of a seed's scope within so many minutes of it, without the seeds. Slots make it an equi-join."""
    width = minutes * 60 * 1_000_000
    slot = F.floor(micros("ts") / width)
    near = seeds.select("scope_id", micros("ts").alias("__s"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("__slot"))
    found = assets.withColumn("__slot", slot).join(near, ["scope_id", "__slot"]).filter(F.abs(micros("ts") - F.col("__s")) <= width)
    return found.select("asset_id").distinct().join(seeds.select("asset_id"), "asset_id", "left_anti")


def siblings(bridge: DataFrame, seeds: DataFrame, group: str, budget: int, order: list[Column]) -> DataFrame:
    """Others of a seed's group (event, album, device), at most budget of each group, without the seeds."""
    groups = bridge.join(seeds.select("asset_id"), "asset_id", "left_semi").select(group).distinct()
    others = bridge.join(groups, group, "left_semi").join(seeds.select("asset_id"), "asset_id", "left_anti")
    kept = others.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= budget)
    return kept.select("asset_id").distinct()


def probe(hits: DataFrame, channels: list[str], agreement_from: int = 2) -> DataFrame:
    """Per query the hits of each channel, the assets that several agree on, and a decision: agreed, scattered or nothing."""
    per = hits.groupBy("query_id", "asset_id").agg(F.countDistinct("channel").alias("n"), F.collect_set("channel").alias("c"))
    counts = [F.count_if(F.array_contains("c", c)).alias(c) for c in channels]
    tally = per.groupBy("query_id").agg(*counts, F.count_if(F.col("n") >= 2).alias("agreeing"))
    decision = F.when(F.col("agreeing") >= agreement_from, "agreed").otherwise("scattered")
    return tally.withColumn("decision", decision)


def probe_outcome(hits: DataFrame, queries: DataFrame, minimums: dict[str, float] | None = None, channels_from: int = 2) -> DataFrame:
    """Whether a message is worth a formal retrieval: query_id, decision, channels, shared, lexical_exact, conflicts and reason.

    queries: query_id and text; hits as of a channel, lexical ones with matched_text if that is known. No hit at all is
    no_match. Otherwise upgrade: if so many channels found something; or the lexical one matched the message whole (one holds
    the other without white space, or a score of 2 or more); or a channel's best score reaches its minimum, where it has one.
    Else clarify. shared: assets that every channel with hits found; conflicts: channels without one of these (all, if there are none).
    """
    has_text = "matched_text" in hits.columns
    said = queries.select("query_id", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s", "").alias("__said"))
    rows = hits.join(said, "query_id", "left")
    matched = F.lower(F.coalesce(F.col("matched_text") if has_text else F.lit(None).cast("string"), F.lit("")))
    within = (matched != "") & (F.contains(matched, F.col("__said")) | F.contains(F.col("__said"), matched))
    exact = (F.col("channel") == "lexical") & (F.coalesce("__said", F.lit("")) != "") & (within | (F.col("raw_score") >= 2.0))
    enough = F.lit(False)
    for channel, least in (minimums or {}).items():
        enough = enough | ((F.col("channel") == channel) & (F.col("raw_score") >= least) & F.lit(least > 0))
    per_query = rows.groupBy("query_id").agg(F.collect_set("channel").alias("__c"), F.max(exact).alias("lexical_exact"), F.max(enough).alias("__enough"))
    each = hits.select("query_id", "asset_id", "channel").distinct().groupBy("query_id", "asset_id").agg(F.collect_set("channel").alias("__by"))
    each = each.join(per_query.select("query_id", "__c"), "query_id")
    shared = each.filter(F.size("__by") == F.size("__c")).groupBy("query_id").agg(F.array_sort(F.collect_set("asset_id")).alias("shared"))
    out = queries.select("query_id").join(per_query, "query_id", "left").join(shared, "query_id", "left")
    n, is_exact = F.coalesce(F.size("__c"), F.lit(0)), F.coalesce("lexical_exact", F.lit(False))
    n = F.when(F.col("__c").isNull(), 0).otherwise(n)
    reason = F.when(n == 0, "none").when(n >= channels_from, "channels").when(is_exact, "exact").when(F.col("__enough"), "score").otherwise("weak")
    decision = F.when(reason == "none", "no_match").when(reason == "weak", "clarify").otherwise("upgrade")
    # With a shared asset every channel with hits has one of the shared.
    conflicts = F.when(F.col("shared").isNull() & F.col("__c").isNotNull(), F.array_sort("__c")).otherwise(F.array().cast("array<string>"))
    return out.select("query_id", decision.alias("decision"), n.alias("channels"), "shared", is_exact.alias("lexical_exact"), conflicts.alias("conflicts"), reason.alias("reason"))
