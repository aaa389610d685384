"""Online assignment of samples to clusters in order of arrival, in batches and in streams with one fold.

Each sample is held against the prototypes of its scope and model as all samples before it have left them: it joins the
cluster of the nearest prototype, if that is near enough, or founds one, and takes the place of its cluster's prototype for its
view if it is of better quality. So two alike samples that arrive together are one cluster. Scopes and models are dealt out;
within one the fold streams over rows in order, with the prototypes (at most LIMIT views a cluster) as its only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.retrieval import by_blocks, kind

#: Prototypes of a cluster at most (one a view), and samples whose products with all prototypes are formed at once.
LIMIT = 6
BLOCK = 256


class Prototypes:
    """The open clusters of one scope and model: a row for each prototype."""

    def __init__(self, threshold: float = 0.30, minimum: float = 0.30, limit: int = LIMIT):
        self.threshold, self.minimum, self.limit = threshold, minimum, limit
        self.names: list[str] = []  # in order of founding
        self.owner, self.view, self.quality = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self.x = np.zeros((0, 0))
        self.n, self.changed = 0, set()
        self.slots: list[dict[str, int]] = []

    def _room(self, dims: int) -> None:
        if self.n < len(self.x):
            return
        more = max(64, len(self.x))
        self.x = np.concatenate([self.x.reshape(-1, dims), np.zeros((more, dims))])
        self.owner, self.quality = np.append(self.owner, np.zeros(more, np.int64)), np.append(self.quality, np.zeros(more))
        self.view = np.append(self.view, np.full(more, None, object))

    def found(self, name: str) -> int:
        self.names.append(name)
        self.slots.append({})
        return len(self.names) - 1

    def put(self, cluster: int, view: str, quality: float, x: np.ndarray) -> int | None:
        """Makes a sample its cluster's prototype, if it is the best of its view (the first of equal ones); its slot, else None."""
        mine = self.slots[cluster]
        slot = mine.get(view)
        if slot is None and len(mine) >= self.limit:  # another view's place, if that is worse than this
            other = min(mine, key=lambda v: (self.quality[mine[v]], v))
            if self.quality[mine[other]] >= quality:
                return None
            slot = mine.pop(other)
        elif slot is not None and self.quality[slot] >= quality:
            return None
        if slot is None:
            self._room(len(x))
            slot, self.n = self.n, self.n + 1
        mine[view] = slot
        self.x[slot], self.owner[slot], self.view[slot], self.quality[slot] = x, cluster, view, quality
        self.changed.add(slot)
        return slot

    def assign(self, keys: list, x: np.ndarray, view: list, quality: np.ndarray, eligible: np.ndarray) -> tuple[list, np.ndarray]:
        """The clusters (None for samples that aren't eligible) and highest similarities of samples in order of arrival."""
        names, scores = [None] * len(keys), np.zeros(len(keys))
        for start in range(0, len(keys), BLOCK):
            part = x[start : start + BLOCK]
            sims = np.full((len(part), self.n + len(part)), -1.0)
            if self.n:
                sims[:, : self.n] = part @ self.x[: self.n].T
            for j in range(len(part)):
                i, cluster = start + j, None
                if not eligible[i]:
                    continue
                if self.n and quality[i] >= self.minimum:
                    best = sims[j, : self.n].max()
                    scores[i] = max(best, 0.0)
                    if best > 0 and best >= self.threshold:
                        cluster = int(self.owner[: self.n][sims[j, : self.n] == best].min())
                if cluster is None:
                    cluster = self.found(f"new_{keys[i]}")
                names[i] = self.names[cluster]
                slot = self.put(cluster, view[i], float(quality[i]), part[j])
                if slot is not None:
                    sims[:, slot] = part @ part[j]
        return names, scores


def _folded(open_: Prototypes, rows: pd.DataFrame, key: str) -> pd.DataFrame:
    """key, cluster_id and score of rows in order."""
    out = rows[["scope_id", "model", key]].copy()
    if rows["eligible"].any():
        some = rows["vector"].map(lambda v: v is not None and len(v) > 0).to_numpy()
        dims = max((len(v) for v in rows["vector"][some]), default=0)
        x = np.zeros((len(rows), dims))
        x[some] = np.stack(rows["vector"][some].to_numpy()) if some.any() else x[some]
        eligible = rows["eligible"].to_numpy(bool) & some
        out["cluster_id"], out["score"] = open_.assign(rows[key].tolist(), x, rows["view"].fillna("unknown").tolist(), rows["quality"].fillna(0.0).to_numpy(float), eligible)
        return out
    return out.assign(cluster_id=None, score=0.0)


def _schema(samples: DataFrame, key: str) -> str:
    return f"scope_id {kind(samples, 'scope_id')}, model {kind(samples, 'model')}, {key} {kind(samples, key)}, cluster_id string, score double"


def _seeded(open_: Prototypes, rows: pd.DataFrame) -> None:
    """The prototypes of known clusters (cluster_id, view, quality, vector), clusters in order of their ids."""
    at = {name: n for n, name in enumerate(open_.names)}
    for name, view, quality, x in zip(rows["cluster_id"], rows["view"].fillna("unknown"), rows["quality"].fillna(0.0), rows["vector"]):
        if name not in at:
            at[name] = open_.found(name)
        open_.put(at[name], view, float(quality), np.asarray(x, float))


def assign_online(samples: DataFrame, known: DataFrame | None, key: str, order: str, **options) -> DataFrame:
    """scope_id, model, key, cluster_id and score of samples, assigned in the order of `order` and key.

    samples: key, scope_id, model, view, quality, eligible, vector (unit) and order. known: the prototypes of clusters that
    there are (scope_id, model, cluster_id, view, quality, vector), in order of cluster_id. Samples that aren't eligible or have
    no vector get no cluster; one under the minimum quality founds a cluster without looking; a new cluster is `new_<key>`.
    """
    columns = ["scope_id", "model", "view", "quality", "vector"]
    rows = samples.select(*columns, "eligible", key, F.col(order).alias("__at"), F.lit(None).cast("string").alias("cluster_id"))
    if known is not None:
        seeds = known.select(*columns, F.lit(True).alias("eligible"), F.col("cluster_id").cast("string").alias("cluster_id"), F.lit("0").cast(kind(samples, key)).alias(key))
        rows = rows.unionByName(seeds, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_ = None, Prototypes(**options)
        for b in batches:
            for group, part in b.groupby(["scope_id", "model"], sort=False, dropna=False):
                if group != at and not (at is not None and all(p == q or (p != p and q != q) for p, q in zip(group, at))):
                    at, open_ = group, Prototypes(**options)
                seed = part["cluster_id"].notna()
                _seeded(open_, part[seed])
                if not seed.all():
                    yield _folded(open_, part[~seed], key)

    first = F.col("cluster_id").isNull().alias("__seed")
    ordered = rows.withColumn("__seed", first).repartition("scope_id", "model").sortWithinPartitions("scope_id", "model", "__seed", "cluster_id", "__at", key, "view")
    return ordered.mapInPandas(run, _schema(samples, key))


class _OnlineProcessor(StatefulProcessor):
    """The same fold over a stream; prototypes are a map in the state store, of which only the changed ones are written."""

    def __init__(self, key: str, order: str, options: dict):
        self.key, self.order, self.options = key, order, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("prototypes", "slot long", "cluster string, ordinal long, view string, quality double, vector array<double>")

    def _opened(self) -> Prototypes:
        open_ = Prototypes(**self.options)
        rows = sorted((slot[0], value) for slot, value in self.kept.iterator())
        names = dict((v[1], v[0]) for _, v in rows)
        for n in range(max(names, default=-1) + 1):
            open_.found(names.get(n, ""))
        for _, (_, ordinal, view, quality, vector) in rows:
            open_.put(int(ordinal), view, float(quality), np.array(vector, float))
        open_.changed.clear()
        return open_

    def _keep(self, open_: Prototypes) -> None:
        for slot in open_.changed:
            n = int(open_.owner[slot])
            self.kept.updateValue((int(slot),), (open_.names[n], n, open_.view[slot], float(open_.quality[slot]), open_.x[slot].tolist()))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        open_ = self._opened()
        _seeded(open_, initialState.sort_values(["cluster_id", "view"]))
        self._keep(open_)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True).sort_values([self.order, self.key], kind="stable", ignore_index=True)
        open_ = self._opened()
        out = _folded(open_, arrived, self.key)
        self._keep(open_)
        yield out

    def close(self) -> None:
        pass


def assigned_stream(samples: DataFrame, known: DataFrame | None, key: str, order: str, **options) -> DataFrame:
    """assign_online() of a stream: what one micro-batch has founded, the next one knows. Needs the RocksDB state store."""
    start = known.withColumn("cluster_id", F.col("cluster_id").cast("string")).groupBy("scope_id", "model") if known is not None else None
    rows = samples.select("scope_id", "model", "view", "quality", "vector", "eligible", key, order).groupBy("scope_id", "model")
    return rows.transformWithStateInPandas(_OnlineProcessor(key, order, options), _schema(samples, key), "Append", "None", start)


def nearest_clusters(samples: DataFrame, clusters: DataFrame, key: str, threshold: float = 0.30, minimum: float = 0.30) -> DataFrame:
    """key, cluster_id and score of samples against clusters as they are, all at once and in blocks: what a review shows before assignment.

    samples: key, scope_id, model, quality, eligible, vector (unit). clusters: cluster_id, scope_id, model, vector, a row for
    each prototype. A sample near none, or of low quality, has no cluster yet.
    """
    asked = samples.filter(F.col("eligible") & (F.col("quality") >= minimum)).select("scope_id", "model", F.col(key).alias("query_id"), F.col("vector").alias("q"))
    known = clusters.select("scope_id", "model", F.col("cluster_id").alias("asset_id"), "vector")
    dots = lambda q, v: np.stack(q["q"].to_numpy()).astype(float) @ np.stack(v["vector"].to_numpy()).astype(float).T
    best = by_blocks(known, asked, ["scope_id", "model"], 1, dots).groupBy("query_id").agg(F.min(F.struct((-F.round("raw_score", 9)).alias("s"), "asset_id")).alias("b"))
    best = best.select(F.col("query_id").alias(key), F.col("b.asset_id").alias("cluster_id"), (-F.col("b.s")).alias("score")).filter(F.col("score") >= threshold)
    return samples.select(key).join(best, key, "left").select(key, "cluster_id", F.coalesce("score", F.lit(0.0)).alias("score"))
