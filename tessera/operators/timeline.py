"""Video timelines: scenes from boundaries, hierarchies by overlap, frame selection scores, keyframe budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.orderstats import even_indices, with_robust_units
from tessera.operators.joins import overlaps
from tessera.operators.retrieval import by_blocks

BOUNDARY = {"residual": 0.42, "histogram": 0.25, "pixel": 0.18, "shift": 0.15}
SUMMARY = {"scene_score": 0.28, "information_gain": 0.22, "sharpness": 0.22, "diversity": 0.13, "representativeness": 0.15}


def weighted(frames: DataFrame, video: str, weights: dict[str, float], name: str) -> DataFrame:
    """frames with the weighted sum of signals, each robustly between 0 and 1 within its video."""
    total = F.lit(0.0)
    for column, w in weights.items():
        total = total + F.col(f"unit_{column}") * w
    return with_robust_units(frames, [video], list(weights)).withColumn(name, total).select(*frames.columns, name)


def _order(t: str, key: str | None) -> list[str]:
    return [t] if key is None else [t, key]


def scenes(frames: DataFrame, video: str, t: str, boundary: str, labels: str, key: str | None = None) -> DataFrame:
    """Scenes between boundaries: start, end, frames and the union of their labels. A boundary opens a scene.

    key: a column by which frames of one time are told apart.
    """
    number = F.sum(F.col(boundary).cast("int")).over(W.partitionBy(video).orderBy(*_order(t, key)).rowsBetween(W.unboundedPreceding, 0))
    found = frames.withColumn("scene_no", number).groupBy(video, "scene_no")
    return found.agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count(F.lit(1)).alias("frames"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(labels)))).alias("labels"))


def merge_short(scene_rows: DataFrame, video: str, shortest: float = 3.0, alike: float = 0.60, key: str | None = None) -> DataFrame:
    """Scenes with short ones joined to the scene before where their labels are alike (Jaccard): a left fold per video.

    key: a column by which scenes of one start are told apart.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values(_order("start_s", key), kind="stable").to_dict("records"):
            now = set(r["labels"])
            if out:
                last = set(out[-1]["labels"])
                union = last | now
                if r["end_s"] - r["start_s"] < shortest and union and len(last & now) / len(union) >= alike:
                    out[-1] |= {"end_s": r["end_s"], "frames": out[-1]["frames"] + r["frames"], "labels": sorted(union)}
                    continue
            out.append(r | {"labels": sorted(now)})
        return pd.DataFrame(out, columns=pdf.columns)

    return scene_rows.groupBy(video).applyInPandas(fold, scene_rows.schema)


def label_sessions(observations: DataFrame, keys: list[str], t: str, gap: float, least: int = 2, samples: int = 5) -> DataFrame:
    """Runs of a label (and track) without a gap, of at least `least` observations, with evenly sampled members."""
    w = W.partitionBy(*keys).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    runs = observations.withColumn("run", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "run")
    found = runs.agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(t)).alias("__m")).filter(F.col("n") >= least)
    picked = F.when(F.col("n") <= samples, F.col("__m")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.get(F.col("__m"), F.floor(i * (F.col("n") - 1) / (samples - 1)).cast("int"))))
    return found.withColumn("members", picked).drop("__m")


def keyframe_budget(frames: DataFrame, video: str, scene: str, score: str, t: str, budget: int = 160, key: str | None = None) -> DataFrame:
    """Per video the best frame of each scene first, then an even stride over the others, up to the budget.

    key: a column by which frames of one time are told apart.
    """
    best = F.row_number().over(W.partitionBy(video, scene).orderBy(F.desc(score), *_order(t, key))) == 1
    marked = frames.withColumn("__best", best)
    rest = marked.withColumn("__n", F.row_number().over(W.partitionBy(video, "__best").orderBy(*_order(t, key)))).withColumn("__all", F.count(F.lit(1)).over(W.partitionBy(video, "__best")))
    firsts = F.sum(F.col("__best").cast("int")).over(W.partitionBy(video))
    room = F.greatest(F.lit(0), F.lit(budget) - firsts)
    stride = F.greatest(F.lit(1), F.ceil(F.col("__all") / F.greatest(room, F.lit(1))))
    strided = (room > 0) & ((F.col("__n") - 1) % stride == 0)
    kept = rest.withColumn("__keep", F.when(F.col("__best"), F.col("__n") <= budget).otherwise(strided)).filter("__keep").drop("__keep")
    return kept.drop("__best", "__n", "__all")


def diversity(frames: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per key the mean pairwise cosine distance of unit vectors, from their sum: (n^2 - |sum|^2) / (n (n - 1)).

    No pairs are formed: the inner products of all pairs add up to the squared length of the vectors' sum.
    """
    each = frames.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    per = each.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    return per.select(*keys, "n", F.when(F.col("n") > 1, (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("diversity"))


def representativeness(frames: DataFrame, chosen: DataFrame, keys: list[str], frame: str, vector: str) -> DataFrame:
    """Per key the mean of exp(-distance) of all frames to the nearest chosen one (cosine distance of unit vectors).

    chosen: keys and vector. Frames meet the chosen ones of their video only, as matrices of bounded blocks; vectors of
    different lengths are at distance 1.
    """

    def products(q: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        """Each frame's greatest product, in one column: which vector it is of is not asked."""
        rows, columns = q["q"].map(len).to_numpy(), v["vector"].map(len).to_numpy()
        out = np.full((len(q), len(v)), -np.inf)
        for n in set(rows):
            i, j = np.flatnonzero(rows == n), np.flatnonzero(columns == n)
            most = (np.stack(q["q"].to_numpy()[i]).astype(float) @ np.stack(v["vector"].to_numpy()[j]).astype(float).T).max(axis=1) if n and len(j) else -np.inf
            out[i, 0] = np.maximum(most, 0.0 if len(j) < len(v) or not n else -np.inf)
        return out

    whole = lambda c: F.coalesce(c, F.array().cast(frames.schema[vector].dataType))
    c = chosen.select(*keys, F.xxhash64(vector).alias("asset_id"), whole(F.col(vector)).alias("vector")).distinct()  # of those with one hash the best counts
    asked = frames.select(*keys, F.struct(*keys, frame).alias("query_id"), whole(F.col(vector)).alias("q"))
    best = by_blocks(c, asked, keys, 1, products).select("query_id.*", "raw_score")
    nearest = best.groupBy(*keys, frame).agg(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - F.max("raw_score"))).alias("d"))
    return nearest.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.avg(F.exp(-F.col("d"))).alias("representativeness"))


def frame_deltas(frames: DataFrame, video: str, order: str, pixels: str, histogram: str) -> DataFrame:
    """frames with pixel_change (mean absolute difference over 255) and histogram_change (Bhattacharyya) to the frame before.

    The first frame of a video has none of either: 0.
    """
    w = W.partitionBy(video).orderBy(order)
    p, h = F.lag(pixels).over(w), F.lag(histogram).over(w)
    rows = frames.withColumn("__p", p).withColumn("__h", h)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    pixel = total(F.zip_with(pixels, "__p", lambda a, b: F.abs(a.cast("double") - b.cast("double")))) / F.size(pixels) / 255
    shared = total(F.zip_with(histogram, "__h", lambda a, b: F.sqrt(a.cast("double") * b.cast("double"))))
    change = F.sqrt(F.greatest(F.lit(0.0), 1 - shared / F.sqrt(total(F.transform(histogram, lambda x: x.cast("double"))) * total(F.transform("__h", lambda x: x.cast("double"))))))
    return rows.withColumn("pixel_change", F.coalesce(pixel, F.lit(0.0))).withColumn("histogram_change", F.coalesce(change, F.lit(0.0))).drop("__p", "__h")


def camera_shift(before: np.ndarray, now: np.ndarray) -> tuple[int, int]:
    """By how many (rows, columns) a grey picture moved, by the peak of the phase correlation."""
    cross = np.fft.fft2(now) * np.conj(np.fft.fft2(before))
    peak = np.unravel_index(np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12))).argmax(), now.shape)
    return tuple(int(p - n if p > n // 2 else p) for p, n in zip(peak, now.shape))


def camera_shifts(frames: DataFrame, video: str, order: str, picture: str, width: int) -> DataFrame:
    """frames with shift_rows, shift_columns and shift (length over the picture's diagonal) to the frame before; 0 for the first."""

    @F.pandas_udf("shift_rows int, shift_columns int, shift double")
    def shift(now: pd.Series, before: pd.Series) -> pd.DataFrame:
        out = []
        for n, b in zip(now, before):
            if b is None or len(b) != len(n):
                out.append((0, 0, 0.0))
                continue
            x, y = (np.asarray(v, float).reshape(-1, width) for v in (n, b))
            r, c = camera_shift(y, x)
            out.append((r, c, float(np.hypot(r, c) / np.hypot(*x.shape))))
        return pd.DataFrame(out, columns=["shift_rows", "shift_columns", "shift"])

    before = F.lag(picture).over(W.partitionBy(video).orderBy(order))
    return frames.withColumn("__b", before).withColumn("__s", shift(picture, "__b")).select(*frames.columns, "__s.*")


def gated_keyframes(frames: DataFrame, video: str, t: str, sharpness: str, novelty: str, change: str, ratio: float = 0.8, shortest: float = 0.35, longest: float = 2.0, gain: float = 0.16) -> DataFrame:
    """frames with gate: blurred, first, maximum_gap, information_gain or redundant.

    A frame is sharp enough at `ratio` of the 70th percentile of the 120 frames before it, which a window gives. Of those,
    which is kept depends on when the last one was: a fold per video that holds one number. Information gain is
    0.72 novelty + 0.28 change / 15 (change clamped to 1).
    """
    w = W.partitionBy(video).orderBy(t).rowsBetween(-120, -1)
    reference = F.coalesce(F.percentile(sharpness, 0.7).over(w), F.col(sharpness))
    worth = 0.72 * F.col(novelty) + 0.28 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(change) / 15))
    rows = frames.withColumn("__sharp", F.col(sharpness) >= reference * ratio).withColumn("gain", worth)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for b in batches:
            gates = []
            for v, now, sharp, g in zip(b[video], b[t], b["__sharp"], b["gain"]):
                if v != at:
                    at, last = v, None
                gap = None if last is None else now - last
                gate = "blurred" if not sharp else "first" if gap is None else "maximum_gap" if gap >= longest else "information_gain" if gap >= shortest and g >= gain else "redundant"
                if gate not in ("blurred", "redundant"):
                    last = now
                gates.append(gate)
            yield b.drop(columns="__sharp").assign(gate=gates)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return rows.repartition(video).sortWithinPartitions(video, t).mapInPandas(run, f"{fields}, gain double, gate string")


def greedy_boundaries(frames: DataFrame, video: str, t: str, score: str, shortest: float = 2.5, fewest: int = 3, floor: float = 0.24, spread: float = 2.4) -> DataFrame:
    """frames that open a scene: the first, and by falling score those over max(floor, median + spread MAD) that lie apart.

    Apart means `shortest` seconds and `fewest` frames from all that were taken. A video's frames over the limit are a fold.
    """
    w = W.partitionBy(video)
    numbered = frames.withColumn("__i", F.row_number().over(w.orderBy(t)) - 1).withColumn("__m", F.percentile(score, 0.5).over(w))
    limit = F.greatest(F.lit(floor), F.col("__m") + spread * F.percentile(F.abs(F.col(score) - F.col("__m")), 0.5).over(w))
    over = numbered.withColumn("__limit", limit).filter((F.col("__i") == 0) | (F.col(score) >= F.col("__limit"))).drop("__m", "__limit")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["__i"] == 0
        order = np.r_[np.flatnonzero(first), pdf[~first].sort_values([score, "__i"], ascending=[False, True], kind="stable").index.to_numpy()]
        at, number, kept = pdf[t].to_numpy(float), pdf["__i"].to_numpy(), []
        for i in order:
            if not kept or (np.abs(at[kept] - at[i]) >= shortest).all() and (np.abs(number[kept] - number[i]) >= fewest).all():
                kept.append(i)
        return pdf.iloc[kept].drop(columns="__i")

    return over.groupBy(video).applyInPandas(lambda pdf: pick(pdf.reset_index(drop=True)), frames.schema)


def summary_frames(frames: DataFrame, video: str, t: str, score: str, gain: str, duration: str, min_gap: float = 0.45, ratio: float = 0.15, frame_seconds: float = 0.5) -> DataFrame:
    """The frames of a video's summary: by falling score (then gain) at least min_gap apart, up to ceil(duration ratio / frame_seconds).

    Where too few lie apart, the earliest others fill the budget up. A video is one fold.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        budget = min(len(pdf), max(1, int(np.ceil(pdf[duration].iloc[0] * ratio / frame_seconds))))
        at, kept = pdf[t].to_numpy(float), []
        for i in pdf.sort_values([score, gain, t], ascending=[False, False, True], kind="stable").index:
            if len(kept) < budget and (np.abs(at[kept] - at[i]) >= min_gap).all():
                kept.append(i)
        rest = [i for i in np.argsort(at, kind="stable") if i not in set(kept)]
        return pdf.iloc[sorted(kept + rest[: budget - len(kept)], key=lambda i: at[i])]

    return frames.groupBy(video).applyInPandas(lambda pdf: pick(pdf.reset_index(drop=True)), frames.schema)


def scene_hierarchy(scene_rows: DataFrame, events: DataFrame, video: str) -> DataFrame:
    """Each scene with its anchors, and for each anchor the events that overlap it: video, scene_no, anchor, kind and members.

    scene_rows: video, scene_no, start_s, end_s. events: video, event_no, kind (Action, Object, Expression), start_s, end_s. A
    scene's actions are its anchors; a scene without one is its own. What overlaps (closed intervals) is found by slots.
    """
    seconds = lambda df: df.withColumn("__a", F.timestamp_micros((F.col("start_s") * 1_000_000).cast("long"))).withColumn("__b", F.timestamp_micros((F.col("end_s") * 1_000_000).cast("long")))
    s, e = seconds(scene_rows).select(video, "scene_no", "__a", "__b"), seconds(events).select(video, "event_no", "kind", F.col("__a").alias("__c"), F.col("__b").alias("__d"))
    inside = overlaps(s, e, [video], "__a", "__b", "__c", "__d", 60.0)
    actions = inside.filter("kind = 'Action'").select(video, "scene_no", F.col("event_no").alias("anchor"), F.col("__c").alias("__x"), F.col("__d").alias("__y"))
    alone = s.join(actions.select(video, "scene_no").distinct(), [video, "scene_no"], "left_anti").select(video, "scene_no", F.lit(None).cast(events.schema["event_no"].dataType).alias("anchor"), F.col("__a").alias("__x"), F.col("__b").alias("__y"))
    anchors = actions.unionByName(alone)
    # The members of a scene are few, so anchors meet them by scene and are then compared.
    members = inside.select(video, "scene_no", "event_no", "kind", "__c", "__d")
    found = anchors.join(members, [video, "scene_no"], "left").filter(F.col("event_no").isNull() | ((F.col("__d") >= F.col("__x")) & (F.col("__c") <= F.col("__y")) & ~F.coalesce(F.col("event_no") == F.col("anchor"), F.lit(False))))
    held = found.groupBy(video, "scene_no", "anchor").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("event_no")))).alias(name) for k, name in (("Action", "actions"), ("Object", "objects"), ("Expression", "expressions"))])
    zero = lambda c: F.coalesce(c, F.array().cast(f"array<{events.schema['event_no'].dataType.simpleString()}>")).alias(c)
    whole = anchors.select(video, "scene_no", "anchor").join(held.withColumnRenamed(video, "__v").withColumnRenamed("scene_no", "__n").withColumnRenamed("anchor", "__k"), (F.col(video) == F.col("__v")) & (F.col("scene_no") == F.col("__n")) & F.col("anchor").eqNullSafe(F.col("__k")), "left")
    return whole.select(video, "scene_no", "anchor", *map(zero, ("actions", "objects", "expressions")))


def dmd_residual(window: np.ndarray, rank: int = 4) -> float:
    """Relative error of the one-step prediction of the last column from those before, by a truncated SVD."""
    x, y = window[:, :-1], window[:, 1:]
    if x.shape[1] < 2:
        return 0.0
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    r = max(1, min(rank, int((s > 1e-10).sum())))
    predicted = u[:, :r] @ ((u[:, :r].T @ y @ vt[:r].T / s[:r]) @ (u[:, :r].T @ x[:, -1]))
    return float(np.linalg.norm(y[:, -1] - predicted) / (np.linalg.norm(y[:, -1]) + 1e-9))


def sampled(items: list, k: int) -> list:
    return [items[i] for i in even_indices(len(items), k)]


def dmd_residuals(frames: DataFrame, video: str, order: str, vector: str, last: int = 10, rank: int = 4) -> DataFrame:
    """frames with dmd_residual: how badly the last frames before it predict each frame's vector; 0 while there are too few."""
    window = F.collect_list(vector).over(W.partitionBy(video).orderBy(order).rowsBetween(-last, 0))

    @F.pandas_udf("double")
    def residual(windows: pd.Series) -> pd.Series:
        return pd.Series([dmd_residual(np.stack([np.asarray(v, float) for v in w], axis=1), rank) if len(w) >= 3 else 0.0 for w in windows])

    return frames.withColumn("__w", window).withColumn("dmd_residual", residual("__w")).drop("__w")


def even_sample(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """k rows of each key spread evenly over its order, ends included: those numbered round(i (n - 1) / (k - 1)), half to even."""
    w = W.partitionBy(*keys)
    numbered = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(k - 1, 1)), 0).cast("int"))
    return numbered.filter((F.col("__n") <= k) | F.array_contains(wanted, F.col("__i").cast("int"))).drop("__i", "__n")
