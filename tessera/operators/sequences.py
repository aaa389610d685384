"""Ordered sequences: sessions by gap, bests of groups, peaks, displacement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.orderstats import with_robust_units
from tessera.operators.joins import micros


def sessions(rows: DataFrame, keys: list[str], ts: str, key: str, gap_seconds: float) -> DataFrame:
    """rows with session_no (from 0 per key): a new one begins where the gap to the row before is longer than gap_seconds."""
    w = W.partitionBy(*keys).orderBy(ts, key)
    new = (micros(ts) - micros(F.lag(ts).over(w)) > int(gap_seconds * 1_000_000)).cast("int")
    return rows.withColumn("session_no", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))


def session_summary(rows: DataFrame, keys: list[str], ts: str, key: str, gap_seconds: float) -> DataFrame:
    found = sessions(rows, keys, ts, key, gap_seconds)
    return found.groupBy(*keys, "session_no").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"))


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; the limit is pushed below the shuffle."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def budget_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def cover(rows: DataFrame, keys: list[str], ts: str, key: str, confidence: str, image: Column | None = None, chosen: Column | None = None) -> DataFrame:
    """Per group the asset of highest (confidence, time, id): of images only, where a condition says which are; a user's choice first."""
    kept = rows if image is None else rows.filter(image)
    picked = F.lit(0) if chosen is None else chosen.cast("int")
    return kept.groupBy(*keys).agg(F.max(F.struct(picked.alias("__u"), confidence, ts, key)).alias("c")).select(*keys, F.col(f"c.{key}").alias(key), F.col(f"c.{confidence}").alias(confidence))


def mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the median and the median absolute deviation."""
    medians = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    spread = rows.join(medians, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return medians.join(spread, keys)


def boundary_scores(frames: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """frames with score: the weighted sum of signals, each brought to 0..1 robustly within its key."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(f"unit_{c}") * w
    return with_robust_units(frames, keys, list(weights)).withColumn("score", total).select(*frames.columns, "score")


def peaks(scored: DataFrame, keys: list[str], ts: str, key: str, quantile: float = 0.88, spread: float = 2.8) -> DataFrame:
    """Rows that are local maxima and reach max(quantile, median + spread * MAD) of their key."""
    w = W.partitionBy(*keys).orderBy(ts, key)
    stats = mad(scored, keys, "score").join(scored.groupBy(*keys).agg(F.percentile("score", quantile).alias("q")), keys)
    limit = F.greatest("q", F.col("median") + spread * F.col("mad"))
    local = scored.withColumn("__before", F.lag("score").over(w)).withColumn("__after", F.lead("score").over(w))
    top = (F.col("score") >= limit) & (F.coalesce("__before", F.lit(-math.inf)) <= F.col("score")) & (F.coalesce("__after", F.lit(-math.inf)) <= F.col("score"))
    return local.join(stats, keys).filter(top).drop("__before", "__after", "median", "mad", "q")


def spaced(rows: DataFrame, keys: list[str], t: str, min_gap: float) -> DataFrame:
    """Rows kept greedily in order of time (seconds, column t): each at least min_gap after the last kept one.

    What is kept depends on what was kept before, which no window expresses: a generator runs through each partition, sorted
    by key and time, holding one number.
    """
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, -math.inf
        for b in batches:
            keep = []
            for k, x in zip(zip(*[b[c] for c in keys]), b[t]):
                if k != last_key:
                    last_key, last = k, -math.inf
                keep.append(x - last >= min_gap)
                if keep[-1]:
                    last = x
            yield b[keep]

    return rows.repartition(*keys).sortWithinPartitions(*keys, t, *[c for c in columns if c not in keys and c != t]).mapInPandas(run, rows.schema)


def by_score(rows: DataFrame, keys: list[str], t: str, score: str, min_gap: float, budget: int) -> DataFrame:
    """Rows picked greedily by falling score, at least min_gap apart, at most budget of each key; one key per task at a time."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        at = pdf[t].to_numpy()
        for i in pdf.sort_values([score, t], ascending=[False, True], kind="stable").index:
            if len(kept) == budget:
                break
            if all(abs(at[i] - at[j]) >= min_gap for j in kept):
                kept.append(i)
        return pdf.loc[sorted(kept, key=lambda i: at[i])]

    return rows.groupBy(*keys).applyInPandas(lambda pdf: pick(pdf.reset_index(drop=True)), rows.schema)


def displacement(rows: DataFrame, keys: list[str], t: str, x: str, y: str, path: float = 0.14, net: float = 0.035, key: str | None = None) -> DataFrame:
    """Per track: path length, net displacement, and whether it moves (both long enough).

    key: a column by which rows of one time are told apart; then the first of those at a track's end is its end.
    """
    order = [] if key is None else [key]
    w = W.partitionBy(*keys).orderBy(t, *order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    ends = rows.withColumn("__step", step).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path"), F.min_by(F.struct(x, y), F.struct(t, *order)).alias("a"), F.min_by(F.struct(x, y), F.struct(-F.col(t), *order)).alias("b"))
    far = F.sqrt(F.pow(F.col(f"b.{x}") - F.col(f"a.{x}"), 2) + F.pow(F.col(f"b.{y}") - F.col(f"a.{y}"), 2))
    return ends.select(*keys, "path", far.alias("net")).withColumn("moving", (F.col("path") >= path) & (F.col("net") >= net))
