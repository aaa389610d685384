"""A stored index of vectors: inverted lists with later additions and removals, and a manifest.

An index is a folder. A segment holds unit vectors, dealt into lists by their nearest centroid and stored by list, so that a
search reads only the lists that its queries visit. What is added later is a further segment over the same centroids; what is
removed is a table of ids; a row is alive if no later segment or removal names its id. The manifest lists all of them and is
written last, so a reader, or a writer that was lost on the way, always finds a whole index. compacted() makes one segment
of what is alive, with centroids of its own, and happens by itself when there are many segments or removals.

Every query visits as many lists as hold RECALL_GOAL of the neighbours in the fitting sample, four times as many under a scope;
a query that finds fewer than k there is held against all lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalog import written
from tessera.operators.clusters import unit
from tessera.operators.retrieval import MAX_BROADCAST_QUERIES, by_blocks, edge_places, kind
from tessera.sources.published import newest, publish

#: The bound of the sample on which centroids are fitted, and the most lists.
FIT_ROWS = 20_000
MAX_LISTS = 1024
RECALL_GOAL = 0.97
GAUGE_QUERIES = 400
GAUGE_K = 20
SCOPE_FACTOR = 4
#: More segments, or more removals (which a search broadcasts), than these are compacted.
MAX_SEGMENTS = 16
MAX_REMOVALS = 1_000_000
#: Vectors of a list that are written by one task.
PART_VECTORS = 100_000
SEED = 7


def _fit(sample: np.ndarray, n_lists: int) -> tuple[np.ndarray, int]:
    """Centroids on the unit sphere, and how many of them a query visits to meet RECALL_GOAL on the sample."""
    rng, sample = np.random.default_rng(SEED), np.unique(sample, axis=0)
    centroids = sample[rng.permutation(len(sample))[:n_lists]]
    for _ in range(8):
        at = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        held = np.bincount(at, minlength=len(centroids)) > 0
        centroids = np.where(held[:, None], unit(sums), centroids)
    asked = rng.permutation(len(sample))[:GAUGE_QUERIES]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(GAUGE_K, len(sample) - 1)]
    if not near.size:
        return centroids, len(centroids)
    order = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1, kind="stable"), axis=1)
    of = (sample @ centroids.T).argmax(axis=1)
    return centroids, int(np.quantile(np.take_along_axis(order, of[near], axis=1), RECALL_GOAL, method="higher")) + 1


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class VectorIndex:
    """An index that has been published under a path. Operations return the index as it is after them."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest

    # --- what is stored ---------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, vectors: DataFrame, path: str, model: str, space: str = "cosine") -> VectorIndex:
        """An index of vectors (asset_id, vector and, if there are scopes, scope_id) of one length. Null and empty vectors are left out."""
        spark, rows = vectors.sparkSession, _rows(vectors)
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("asset_id", F.lit(SEED))).limit(FIT_ROWS).select("vector").toPandas()
        centroids, probes = _fit(unit(_stack(sample["vector"])), max(1, min(MAX_LISTS, round(n**0.5)))) if n else (np.zeros((1, 0)), 1)
        number = (newest(spark, path) or {"number": -1})["number"] + 1
        fields = {"index_version": 1, "number": number, "space": space, "distance": "cosine", "normalized": True, "model_id": model, "dimension": centroids.shape[1], "probes": probes, "id_type": kind(rows, "asset_id"), "segments": [], "removals": []}
        index = cls(spark, path, fields)
        folder = f"centroids-{uuid.uuid4().hex}"
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/{folder}")
        index.manifest["centroids"] = folder
        return index._with_segment(rows)._published()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """The index that was published last under a path."""
        found = newest(spark, path)
        if not found:
            raise ValueError(f"no_manifest: {path}")
        return cls(spark, path, found)

    def save(self, path: str) -> VectorIndex:
        """What is alive, as an index of its own under another path."""
        return VectorIndex.build(self.live(), path, self.manifest["model_id"], self.manifest["space"])

    def incompatible(self, model: str | None = None, dimension: int | None = None, space: str = "cosine") -> str | None:
        """Why vectors of this model, dimension and space must not be searched here; None if they may."""
        m = self.manifest
        if dimension is not None and m["dimension"] != dimension:
            return f"dimension_mismatch:{m['dimension']}vs{dimension}"
        if model and m["model_id"] != model:
            return f"model_mismatch:{m['model_id']}vs{model}"
        return None if m["space"] == space else f"space_mismatch:{m['space']}"

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Further vectors; one whose id is known takes the place of the old one."""
        return self._next()._with_segment(_rows(vectors))._published()._tidy()

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Without the ids (asset_id); unknown ones change nothing."""
        out, folder = self._next(), f"removed-{uuid.uuid4().hex}"
        ids.select(F.col("asset_id").cast(self.manifest["id_type"])).distinct().write.parquet(f"{self.path}/{folder}")
        out.manifest["removals"].append({"folder": folder, "seq": out._seq(), "n": self._removed(folder).count()})
        return out._published()._tidy()

    def compacted(self) -> VectorIndex:
        """One segment of what is alive, under the same path. Old folders stay for readers that have the old manifest."""
        return VectorIndex.build(self.live(), self.path, self.manifest["model_id"], self.manifest["space"])

    def live(self) -> DataFrame:
        """asset_id, scope_id and vector of what is alive."""
        return self._alive(None).select("asset_id", "scope_id", "vector")

    def _next(self) -> VectorIndex:
        return VectorIndex(self.spark, self.path, json.loads(json.dumps(self.manifest)) | {"number": self.manifest["number"] + 1})

    def _seq(self) -> int:
        return len(self.manifest["segments"]) + len(self.manifest["removals"])

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.schema("list int, centroid array<double>").parquet(f"{self.path}/{self.manifest['centroids']}").collect()  # MAX_LISTS rows at most
        return np.array([r["centroid"] for r in sorted(rows, key=lambda r: r["list"])])

    def _with_segment(self, rows: DataFrame) -> VectorIndex:
        centroids, folder = self.spark.sparkContext.broadcast(self._centroids()), f"segment-{uuid.uuid4().hex}"

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = unit(_stack(b["vector"]))
                    yield b.assign(vector=x.astype(np.float32).tolist(), list=(x @ centroids.value.T).argmax(axis=1).astype(np.int32))

        placed = rows.mapInPandas(dealt, f"{self._schema()}, list int")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Most lists are one file; a long one is as many as its ids' hashes give.
        n = rows.count()
        size = max(1, n // PART_VECTORS)
        placed.repartition(max(tasks, size), "list", F.pmod(F.xxhash64("asset_id"), F.lit(size))).write.partitionBy("list").parquet(f"{self.path}/{folder}")
        self.manifest["segments"].append({"folder": folder, "seq": self._seq(), "n": n})
        return self

    def _schema(self) -> str:
        return f"asset_id {self.manifest['id_type']}, scope_id string, vector array<float>"

    def _published(self) -> VectorIndex:
        ids = self._alive(None).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("asset_id")).alias("x"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("asset_id"))), 256).alias("sum")).first()
        self.manifest |= {"source_count": ids["n"], "id_map_checksum": ids["sum"][:16]}
        publish(self.spark, self.path, self.manifest)
        return self

    def _tidy(self) -> VectorIndex:
        named = sum(x["n"] for x in self.manifest["segments"][1:] + self.manifest["removals"])
        many = len(self.manifest["segments"]) > MAX_SEGMENTS or named > MAX_REMOVALS
        return self.compacted() if many else self

    def _segment(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{self._schema()}, list int").parquet(f"{self.path}/{folder}")

    def _removed(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"asset_id {self.manifest['id_type']}").parquet(f"{self.path}/{folder}")

    def _alive(self, lists: list[int] | None) -> DataFrame:
        """Rows that no later part of the index names; of these lists only (None: of all)."""
        parts = []
        for s in self.manifest["segments"]:
            rows = self._segment(s["folder"])
            parts.append((rows if lists is None else rows.filter(F.col("list").isin(lists))).withColumn("seq", F.lit(s["seq"])))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        later = [self._segment(s["folder"]).select("asset_id", F.lit(s["seq"]).alias("dead")) for s in self.manifest["segments"] if s["seq"]]
        later += [self._removed(r["folder"]).select("asset_id", F.lit(r["seq"]).alias("dead")) for r in self.manifest["removals"]]
        if not later:
            return rows.drop("seq")
        dead = later[0]
        for p in later[1:]:
            dead = dead.unionByName(p)
        # At most MAX_REMOVALS ids and what a further step brought: beyond it the index is compacted.
        dead = dead.groupBy("asset_id").agg(F.max("dead").alias("dead"))
        dead = F.broadcast(dead) if dead.count() <= 2 * MAX_REMOVALS else dead
        rows = rows.join(dead, "asset_id", "left")
        return rows.filter(F.col("dead").isNull() | (F.col("dead") <= F.col("seq"))).drop("dead", "seq")

    # --- search -----------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, probes: int | None = None, model: str | None = None) -> DataFrame:
        """query_id, asset_id, raw_score and rank: the k best of each query (query_id, q and, if wanted, scope_id) by cosine.

        probes: lists to visit (None: as many as the sample asked for). A null scope_id is any scope. Queries of another
        length, null and empty ones find nothing.
        """
        if model and (why := self.incompatible(model=model)):
            raise ValueError(why)
        scope = F.col("scope_id").cast("string") if "scope_id" in queries.columns else F.lit(None).cast("string")
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), scope.alias("scope_id")).filter(F.size("q") == self.manifest["dimension"])
        first, lists = probes or self.manifest["probes"], len(self._centroids())
        found = written(self._ranked(self._visited(asked, k, first), k), "index-hits")
        short = asked.join(found.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
        if first >= lists or short.isEmpty():
            return found
        again = self._ranked(self._visited(short, k, lists), k)
        return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("raw_score"), "asset_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def _visited(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, asset_id and raw_score: candidates that hold each query's k best of the lists it visits."""
        if asked.limit(MAX_BROADCAST_QUERIES + 1).count() > MAX_BROADCAST_QUERIES:
            return self._joined(asked, k, probes)
        rows = asked.collect()  # MAX_BROADCAST_QUERIES at most
        out = f"query_id {kind(asked, 'query_id')}, asset_id {self.manifest['id_type']}, raw_score double"
        if not rows:
            return self.spark.createDataFrame([], out)
        q, scopes = unit(np.array([r["q"] for r in rows], float)), np.array([r["scope_id"] for r in rows], object)
        visits = _visits(q, scopes, self._centroids(), probes)
        known = self.spark.sparkContext.broadcast(([r["query_id"] for r in rows], q, scopes, visits))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, scopes, visits = known.value
            for b in batches:
                for number, part in b.groupby("list"):
                    at = np.flatnonzero(visits[:, number])
                    scores = _scores(q[at], scopes[at], part)
                    i, j = edge_places(scores, k)
                    yield pd.DataFrame({"query_id": [ids[x] for x in at[i]], "asset_id": part["asset_id"].to_numpy()[j], "raw_score": scores[i, j]})

        lists = np.flatnonzero(visits.any(axis=0)).tolist()
        live = self._alive(None if len(lists) == visits.shape[1] else lists)
        return live.select("asset_id", "scope_id", "vector", "list").mapInPandas(run, out)

    def _joined(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        """The same for any number of queries: these are dealt out to the lists, and both into blocks of bounded size."""
        centroids = self.spark.sparkContext.broadcast(self._centroids())

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    visits = _visits(unit(_stack(b["q"])), b["scope_id"].to_numpy(object), centroids.value, probes)
                    i, j = np.nonzero(visits)
                    yield b.iloc[i].assign(list=j.astype(np.int32))

        left = asked.mapInPandas(visit, f"query_id {kind(asked, 'query_id')}, q array<double>, scope_id string, list int")

        def score(queries: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
            return _scores(unit(_stack(queries["q"])), queries["scope_id"].to_numpy(object), part)

        return by_blocks(self._alive(None), left, ["list"], k, score)


def _rows(vectors: DataFrame) -> DataFrame:
    """asset_id, scope_id and vector; of several vectors of an id the greatest, so that a rerun agrees."""
    scope = F.col("scope_id").cast("string") if "scope_id" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select("asset_id", scope.alias("scope_id"), F.col("vector").cast("array<float>").alias("vector")).filter(F.col("asset_id").isNotNull() & (F.size("vector") > 0))
    return rows.groupBy("asset_id").agg(F.max(F.struct("scope_id", "vector")).alias("v")).select("asset_id", "v.scope_id", "v.vector")


def _visits(q: np.ndarray, scopes: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Which lists (columns) each query visits."""
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    scoped = np.array([s is not None and s == s for s in scopes])
    return place < np.where(scoped, probes * SCOPE_FACTOR, probes)[:, None]


def _scores(q: np.ndarray, scopes: np.ndarray, part: pd.DataFrame) -> np.ndarray:
    """Cosines (queries x rows); -inf where the row is of another scope than the query asks for."""
    scores = q @ _stack(part["vector"]).T
    own = part["scope_id"].to_numpy(object)
    for i, s in enumerate(scopes):
        if s is not None and s == s:
            scores[i, own != s] = -np.inf
    return scores
