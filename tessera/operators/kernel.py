"""The retrieval kernel: recall, rank, conditions, gated adjacency, order, gaps — as one DataFrame plan for a batch of queries.

assets: asset_id, scope_id, ts, media_type, and the groups in which neighbours are looked for (event_id, album). observations:
obs_id, asset_id, place, people (array), text. Queries of a batch share their constraints; hits carry the query_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import retrieval
from tessera.operators.joins import micros
from tessera.operators.retrieval import evaluated, rank_backbone, rank_late_fusion, rank_visual_only
from tessera.plans.spec import SEMANTIC, Constraint

STRATEGIES = {"visual_only": rank_visual_only, "visual_backbone": rank_backbone, "late_fusion": rank_late_fusion}
_LEVELS = ("exact", "strong", "approximate")


@dataclass(frozen=True)
class Budget:
    """How far the neighbourhood of a reliable hit reaches."""

    seeds: int = 8
    event: int = 4
    album: int = 2
    minutes: int = 120


def level_place(level: Column) -> Column:
    return F.when(level == _LEVELS[0], 0).when(level == _LEVELS[1], 1).otherwise(2)


def conditions(candidates: DataFrame, assets: DataFrame, observations: DataFrame, constraints: tuple[Constraint, ...]) -> DataFrame:
    """candidates (query_id, asset_id, position) with conditions, level and score of their best observation; excluded ones go.

    An asset without observations is judged by itself. The best observation is one that isn't excluded, of the best level,
    then score, then the smallest id.
    """
    wide = candidates.join(assets, "asset_id").join(observations, "asset_id", "left").withColumn("people", F.coalesce("people", F.array().cast("array<string>")))
    judged = evaluated(wide, constraints)
    said = F.array_join(F.map_values("conditions"), ",")  # between repeated rows of one id
    worth = F.struct(F.col("excluded").cast("int").alias("e"), level_place(F.col("level")).alias("l"), (-F.col("score")).alias("s"), F.coalesce(F.col("obs_id").cast("long"), F.lit(-1)).alias("o"), said.alias("c"))
    best = judged.groupBy("query_id", "asset_id", "position").agg(F.min_by(F.struct("conditions", "level", "score", "excluded"), worth).alias("b")).filter(~F.col("b.excluded"))
    return best.select("query_id", "asset_id", "position", "b.conditions", "b.level", "b.score")


def neighbours(assets: DataFrame, seeds: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """query_id and asset_id of what lies near the seeds (query_id, asset_id): in time, in their events, in their albums.

    The union of three expansions without the seeds. Each is an equi-join: on scope and time slot, on event, on album. The seeds
    are a few of each query, so they are written and counted, and assets don't move to meet them.
    """
    own = catalog.small(catalog.written(seeds.join(assets, "asset_id"), "seeds"))
    width = budget.minutes * 60 * 1_000_000
    slot = F.floor(micros("ts") / width)
    near = own.select("query_id", "scope_id", micros("ts").alias("__s"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("__slot"))
    timed = assets.withColumn("__slot", slot).join(near, ["scope_id", "__slot"]).filter(F.abs(micros("ts") - F.col("__s")) <= width).select("query_id", "asset_id")

    def group(column: str, most: int) -> DataFrame:
        shared = assets.select("asset_id", column).join(own.select("query_id", column).distinct(), column).join(seeds, ["query_id", "asset_id"], "left_anti")
        first = F.row_number().over(W.partitionBy("query_id", column).orderBy("asset_id"))
        return shared.withColumn("__n", first).filter(F.col("__n") <= most).select("query_id", "asset_id")

    found = timed.unionByName(group("event_id", budget.event)).unionByName(group("album", budget.album)).distinct()
    return found.join(seeds, ["query_id", "asset_id"], "left_anti")


def single(assets: DataFrame, observations: DataFrame, constraints: tuple[Constraint, ...], top_k: int | None = 10) -> DataFrame:
    """All assets judged: asset_id, level, score and ordinal, best first. top_k None keeps all that is relevant."""
    rows = assets.select(F.lit(0).alias("query_id"), "asset_id", F.col("asset_id").alias("position"))
    return _ordered(conditions(rows, assets, observations, constraints), top_k).drop("query_id")


def _ordered(items: DataFrame, top_k: int | None) -> DataFrame:
    """Level before score before the place in recall; at most top_k of each query, or all."""
    w = W.partitionBy("query_id").orderBy(level_place(F.col("level")), F.desc("score"), "position")
    rows = items.withColumn("ordinal", F.row_number().over(w))
    return rows if top_k is None else rows.filter(F.col("ordinal") <= top_k)


def multi(hits: DataFrame, assets: DataFrame, observations: DataFrame, constraints: tuple[Constraint, ...], strategy: str = "visual_backbone", top_k: int = 10, all_relevant: bool = False, budget: Budget = Budget()) -> DataFrame:
    """What the channels recalled, ranked, judged, and widened around reliable hits: query_id, asset_id, conditions, level, score, origin, ordinal.

    Hits of exact or strong level are seeds, the best-placed first. Neighbours that weren't recalled are judged like the others
    and come after them among equals. A visual ranking alone isn't widened, unless all that is relevant is asked for.
    """
    few = lambda rows, what: catalog.small(catalog.written(rows, what))  # noqa: E731  at most top_k rows a query
    ranked = few(STRATEGIES[strategy](hits).filter(F.col("position") <= top_k).select("query_id", "asset_id", F.col("position").cast("long").alias("position")), "ranked")
    primary = catalog.written(conditions(ranked, assets, observations, constraints).withColumn("origin", F.lit("recall")), "primary")
    if strategy != "visual_only" or all_relevant:
        place = F.row_number().over(W.partitionBy("query_id").orderBy("position"))
        seeds = primary.filter(F.col("level") != "approximate").withColumn("__n", place).filter(F.col("__n") <= budget.seeds).select("query_id", "asset_id")
        found = neighbours(assets, seeds, budget)
        found = found.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("asset_id")).cast("long")).filter(F.col("position") <= top_k)
        new = found.join(primary.select("query_id", "asset_id"), ["query_id", "asset_id"], "left_anti").withColumn("position", F.col("position") + top_k)
        primary = primary.unionByName(conditions(few(new, "adjacent"), assets, observations, constraints).withColumn("origin", F.lit("adjacency")))
    return _ordered(primary, None if all_relevant else top_k)


def gaps(items: DataFrame, constraints: tuple[Constraint, ...], queries: DataFrame) -> DataFrame:
    """query_id and condition of every semantic constraint that no item of a query matches. queries: query_id."""
    asked = queries.select("query_id").distinct().withColumn("condition", F.explode(F.array(*[F.lit(c.key) for c in constraints if c.strictness == SEMANTIC]).cast("array<string>")))
    met = items.select("query_id", F.explode("conditions").alias("condition", "status")).filter("status = 'matched'").select("query_id", "condition").distinct()
    return asked.join(met, ["query_id", "condition"], "left_anti")


def metadata_search(assets: DataFrame, observations: DataFrame, passes: Column, k: int = 500) -> DataFrame:
    """The newest assets of which the asset or an observation passes, each once: asset_id and ordinal (a top-k report)."""
    rows = assets.join(observations, "asset_id", "left").filter(passes).select("asset_id", "ts").distinct()
    top = rows.orderBy(F.desc_nulls_last("ts"), "asset_id").limit(k)
    return top.withColumn("ordinal", F.row_number().over(W.orderBy(F.desc_nulls_last("ts"), "asset_id"))).select("asset_id", "ordinal")


def recall(enabled: dict[str, bool], arguments: dict[str, dict]) -> list[DataFrame]:
    """The hits of the enabled channels, each from its registered retriever; a channel without arguments has nothing to go by."""
    unknown = (set(enabled) | set(arguments)) - set(retrieval.RETRIEVERS)
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    return [find(**arguments[name]) for name, find in retrieval.RETRIEVERS.items() if enabled.get(name, False) and name in arguments]
