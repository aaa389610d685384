"""Groupings that depend on the order of arrival: clusters by quality, online assignment, rows of text, tracks, boxes.

Each of these is a fold whose next step needs all that went before. Spark deals the groups out; within one the fold runs in a
fixed total order over numpy matrices. What an image, frame or scope and model holds bounds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog import small, written
from tessera.functions.vector import l2_normalised, norm
from tessera.operators.entities import canonical, connected
from tessera.operators.retrieval import by_blocks, kind

#: How a sample's similarities to the members of its own view are brought to one number.
AGREEMENT: dict[str, Callable[[np.ndarray], float]] = {
    "all": np.min,
    "mean": np.mean,
    "topk": lambda s: np.sort(s)[-3:].mean(),
    "p10": lambda s: np.sort(s)[int(len(s) * 0.1)],
}
UNKNOWN_VIEW = "unknown"
#: Samples whose products with all prototypes are formed at once.
BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


class _Grown:
    """The clusters of one scope and model so far: their prototypes as rows of the sample matrix, and members by view."""

    def __init__(self, x: np.ndarray, view: np.ndarray, kept: np.ndarray, limit: int):
        self.x, self.view, self.kept, self.limit = x, view, kept, limit
        self.prototype, self.owner = np.zeros(0, int), np.zeros(0, int)
        self.members: list[dict[str, list[int]]] = []
        self.named: list[set] = []

    def best(self, sims: np.ndarray) -> np.ndarray:
        """The highest similarity of each cluster's prototypes; -1 for clusters that nothing may join."""
        out = np.full(len(self.members), -1.0)
        np.maximum.at(out, self.owner, sims)
        return out

    def agrees(self, cluster: int, i: int, agreement: Callable[[np.ndarray], float], threshold: float) -> bool:
        views = self.members[cluster]
        alike = sum(views.values(), []) if self.view[i] == UNKNOWN_VIEW else views.get(self.view[i], [])
        if alike and agreement(self.x[alike] @ self.x[i]) < threshold:
            return False
        return self.kept[i] is None or not self.named[cluster] or self.kept[i] in self.named[cluster]

    def add(self, i: int, cluster: int | None, open_: bool = True) -> int:
        """Puts a sample into a cluster (a new one for None); the first of its view becomes a prototype."""
        if cluster is None:
            cluster = len(self.members)
            self.members.append({})
            self.named.append(set())
        views = self.members[cluster]
        if open_ and self.view[i] not in views and len(views) < self.limit:
            self.prototype, self.owner = np.append(self.prototype, i), np.append(self.owner, cluster)
        views.setdefault(self.view[i], []).append(i)
        if self.kept[i] is not None:
            self.named[cluster].add(self.kept[i])
        return cluster


def grow(x: np.ndarray, view: np.ndarray, quality: np.ndarray, kept: np.ndarray, threshold: float = 0.30, minimum: float = 0.30, limit: int = 6, strategy: str = "all") -> np.ndarray:
    """Cluster numbers of samples in order (best first; unit vectors of one model).

    A sample joins the cluster whose best prototype is nearest, at the threshold at least, if the members of its own view
    agree (all members, where the view is unknown) and no other kept identity is in it; else the next nearest. A sample
    under the minimum quality is a cluster of its own that nothing joins.
    """
    grown, out = _Grown(x, view, kept, limit), np.empty(len(x), int)
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        known = len(grown.prototype)
        before, among = part @ x[grown.prototype].T, part @ part.T  # prototypes so far, and those that this block adds
        for j in range(len(part)):
            i, chosen, good = start + j, None, quality[start + j] >= minimum
            if good and len(grown.members):
                best = grown.best(np.concatenate([before[j], among[j, grown.prototype[known:] - start]]))
                near = np.flatnonzero(best >= threshold)
                chosen = next((int(c) for c in near[np.lexsort((near, -best[near]))] if grown.agrees(c, i, AGREEMENT[strategy], threshold)), None)
            out[i] = grown.add(i, chosen, good)
    return out


def quality_clusters(ids: list, vectors: np.ndarray, quality: list, pose: list, model: list, kept: list | None = None, **options) -> dict:
    """The founder (first member) of each id's cluster; models are never mixed."""
    frame = pd.DataFrame({"id": ids, "quality": quality, "pose": pose, "model": model, "kept": pd.Series(kept or [None] * len(ids), dtype=object), "row": range(len(ids))})
    out = {}
    for _, g in frame.groupby("model", sort=False):
        g = g.sort_values(["quality", "id"], ascending=[False, True])
        number = grow(vectors[g["row"].to_numpy()], g["pose"].to_numpy(object), g["quality"].to_numpy(float), g["kept"].to_numpy(object), **options)
        founder = {}
        for key, n in zip(g["id"], number):
            out[key] = founder.setdefault(n, key)
    return out


#: A scope and model of more samples than this is parted before it is folded; blocks of samples whose products one task forms.
MAX_FOLD = 20_000
PART_BLOCK = 4096


def _forest(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (row of x, row of y) of a spanning forest of all pairs at the threshold: each row's first partner, and what joins those."""
    n, m = len(x), len(y)
    up = np.arange(n if same else n + m)
    shift = 0 if same else n
    edges: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for start in range(0, n, BLOCK):
        near = x[start : start + BLOCK] @ y.T >= threshold
        for r in range(len(near)):
            i = start + r
            partners = np.flatnonzero(near[r])
            if not partners.size:
                continue
            while not np.array_equal(flat := up[up], up):
                up[:] = flat
            # One partner of each set is enough.
            for j in partners[np.unique(up[partners + shift], return_index=True)[1]]:
                p, q = top(i), top(int(j) + shift)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    edges.append((i, int(j)))
    out = np.array(edges, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def parted(rows: DataFrame, keys: list[str], key: str, vector: str, threshold: float) -> DataFrame:
    """keys, key and part of rows with unit vectors: parts are what chains of pairs at the threshold connect.

    The samples of a group of keys are cut into blocks and each pair of blocks is a task, which tells a spanning forest of
    its links and never all pairs; the forests are then contracted.
    """
    sizes = small(written(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_BLOCK).cast("long").alias("__blocks")), "blocks"))
    dealt = rows.join(sizes, keys).withColumn("__own", F.pmod(F.xxhash64(key), F.col("__blocks")))
    # A pair (i, j) of blocks, i <= j: a sample of block b is in all pairs with b.
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    pairs = dealt.select(*keys, F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"), "__own", F.col(key).alias("id"), F.col(vector).alias("x"))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["__i"].iloc[0], pdf["__j"].iloc[0]
        left, right = pdf[pdf["__own"] == i], pdf[pdf["__own"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"a": left["id"][:0], "b": left["id"][:0]})
        p, q = _forest(np.stack(left["x"].to_numpy()).astype(float), np.stack(right["x"].to_numpy()).astype(float), i == j, threshold)
        return pd.DataFrame({"a": left["id"].to_numpy()[p], "b": right["id"].to_numpy()[q]})

    id_type = kind(rows, key)
    found = pairs.groupBy(*keys, "__i", "__j").applyInPandas(links, f"a {id_type}, b {id_type}")
    parts = connected(found).withColumnRenamed("id", "__id")
    return rows.select(*keys, key).join(parts, F.col(key) == F.col("__id"), "left").select(*keys, key, F.coalesce("root", key).alias("part"))


def cluster_by_quality(rows: DataFrame, scope: str, key: str, vector: str, quality: str, pose: str, model: str, kept: str | None = None, threshold: float = 0.30, minimum: float = 0.30, **options) -> DataFrame:
    """scope, model, key and cluster (the key of its founder) of every row; keys are unique.

    kept: a column of identities that a user gave; clusters with one never take in samples of another. A scope and model is one
    fold, or, if it has more than MAX_FOLD samples, one for each of its parts: a sample can only join a cluster with a
    prototype at the threshold, so what no chain of such pairs connects never meets, and folds of the parts give the same clusters.
    A sample under the minimum quality is alone, and so a part of its own. The largest part still has to fit a task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["__x"].to_numpy()).astype(np.float64)
        names = [None if pd.isna(v) else v for v in pdf[kept]] if kept else None
        found = quality_clusters(pdf[key].tolist(), x, pdf[quality].tolist(), pdf[pose].tolist(), pdf[model].tolist(), names, threshold=threshold, minimum=minimum, **options)
        return pd.DataFrame({scope: pdf[scope], model: pdf[model], key: pdf[key], "cluster": [found[i] for i in pdf[key]]})

    out = f"{scope} {kind(rows, scope)}, {model} {kind(rows, model)}, {key} {kind(rows, key)}, cluster {kind(rows, key)}"
    wide = F.transform(vector, lambda x: x.cast("double"))
    rows = rows.withColumn("__x", F.when(norm(F.col(vector)) > 0, l2_normalised(F.col(vector))).otherwise(wide))
    large = written(rows.groupBy(scope, model).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > MAX_FOLD), "large-scopes")
    if large.isEmpty():
        return rows.groupBy(scope, model).applyInPandas(fold, out)
    big = small(large.select(scope, model))
    rest = rows.join(big, [scope, model], "left_anti").groupBy(scope, model).applyInPandas(fold, out)
    many = written(rows.join(big, [scope, model], "left_semi"), "large-scope")
    good = F.col(quality) >= minimum
    parts = parted(many.filter(good), [scope, model], key, "__x", threshold).select(key, "part")
    alone = many.filter(~F.coalesce(good, F.lit(False))).select(F.col(scope), F.col(model), F.col(key), F.col(key).alias("cluster"))
    folded = many.join(parts, key).groupBy(scope, model, "part").applyInPandas(fold, out)
    return rest.unionByName(folded).unionByName(alone)


def operated(members: DataFrame, clusters: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (sample, cluster_id) and clusters (cluster_id, status, name) after a batch of operations on clusters.

    operations: op, cluster_id, target, name, samples; a cluster may have several, and they may hang together. First the splits:
    the listed samples go to the target, a new pending cluster. Then the merges, through chains: all members go to the cluster
    that a target has become in the end, and the sources are rejected; of several merges of a cluster that into the smallest
    target holds. Confirming a cluster by the name of a confirmed one, or of one that is confirmed in the same batch and has a
    smaller id, merges it into that. Then the confirmations name what their clusters have become (of several names the first
    by id), and at last the rejections empty it.
    """
    known = clusters.filter("status = 'confirmed'").select("name", F.lit(0).alias("late"), "cluster_id")
    new = operations.filter("op = 'confirm'").select("name", F.lit(1).alias("late"), "cluster_id")
    owner = known.unionByName(new).groupBy("name").agg(F.min(F.struct("late", "cluster_id"))["cluster_id"].alias("target"))
    named = new.join(owner, "name").filter("cluster_id <> target").select(F.col("cluster_id").alias("source"), "target")
    merges = operations.filter("op = 'merge'").select(F.col("cluster_id").alias("source"), "target").unionByName(named)
    roots = small(written(canonical(merges), "cluster-roots"))
    home = lambda rows, c: rows.join(roots, rows[c] == roots["id"], "left").withColumn("__home", F.coalesce("root", c)).drop("id", "root")
    rejected = home(operations.filter("op = 'reject'").select("cluster_id"), "cluster_id").select(F.col("__home").alias("__gone")).distinct()
    named = home(operations.filter("op = 'confirm'").select("cluster_id", F.col("name").alias("__new")), "cluster_id").groupBy(F.col("__home").alias("__named")).agg(F.min(F.struct("cluster_id", "__new"))["__new"].alias("__new"))
    split = operations.filter("op = 'split'").select("cluster_id", "target", F.explode("samples").alias("sample")).groupBy("cluster_id", "sample").agg(F.min("target").alias("__split"))
    moved = members.join(split, ["cluster_id", "sample"], "left").withColumn("__to", F.coalesce("__split", "cluster_id"))
    moved = home(moved, "__to").join(rejected, F.col("__home") == F.col("__gone"), "left")
    fresh = operations.filter("op = 'split'").select(F.col("target").alias("cluster_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("name")).distinct()
    all_ = home(clusters.unionByName(fresh.join(clusters.select("cluster_id"), "cluster_id", "left_anti")), "cluster_id")
    all_ = all_.join(rejected, F.col("cluster_id") == F.col("__gone"), "left").join(named, F.col("cluster_id") == F.col("__named"), "left")
    status = F.when((F.col("cluster_id") != F.col("__home")) | F.col("__gone").isNotNull(), "rejected").when(F.col("__new").isNotNull(), "confirmed").otherwise(F.col("status"))
    after = all_.select("cluster_id", status.alias("status"), F.coalesce("__new", "name").alias("name"))
    return moved.select("sample", F.when(F.col("__gone").isNull(), F.col("__home")).alias("cluster_id")), after


def centroid_similarity(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Each cluster's nearest other cluster by the cosine of mean vectors: cluster, nearest (the smallest of equal ones), similarity.

    Centroids are compared in blocks of bounded size, however many clusters there are.
    """
    sums = rows.select(cluster, F.posexplode(vector).alias("d", "x")).groupBy(cluster, "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    mean = sums.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("v"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("__length"))
    unit_ = mean.filter("__length > 0").select(F.col(cluster).alias("asset_id"), F.transform("v", lambda x: x["s"] / F.col("__length")).alias("vector"))
    unit_ = written(unit_.withColumn("__size", F.size("vector")), "centroids")
    asked = unit_.select("__size", F.col("asset_id").alias("query_id"), F.col("vector").alias("q"))

    def cosines(q: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        out = np.stack(q["q"].to_numpy()) @ np.stack(v["vector"].to_numpy()).T
        out[q["query_id"].to_numpy()[:, None] == v["asset_id"].to_numpy()] = -np.inf
        return out.round(9)

    near = by_blocks(unit_, asked, ["__size"], 1, cosines)
    best = near.groupBy("query_id").agg(F.min(F.struct((-F.round("raw_score", 9)).alias("s"), "asset_id")).alias("b"))
    return best.select(F.col("query_id").alias(cluster), F.col("b.asset_id").alias("nearest"), (-F.col("b.s")).alias("similarity"))


# --- text rows, tracks, boxes ---------------------------------------------------------------------------------------


def text_rows(boxes: DataFrame, keys: list[str], y: str, order: list[str], tolerance: float = 26.0) -> DataFrame:
    """boxes with row_no: each box, from top to bottom, goes to the first row whose first box is within the tolerance.

    From top to bottom only the last row can be within it, so a row is a run that is left when its first box is too far.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, first = None, -1, -np.inf
        for rows in batches:
            out = []
            for *key, v in zip(*[rows[k] for k in keys], rows[y]):
                if key != at:
                    at, number, first = key, -1, -np.inf
                if v - first > tolerance:
                    number, first = number + 1, v
                out.append(number)
            yield rows.assign(row_no=np.array(out, np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema)
    return boxes.repartition(*keys).sortWithinPartitions(*keys, y, *order).mapInPandas(run, f"{fields}, row_no int")


def assign_greedily(costs: DataFrame, keys: list[str], row: str, column: str, cost: str, most: float = 1.85) -> DataFrame:
    """Of each key's (row, column, cost) the pairs taken by rising cost, each row and column once, none above `most`."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns, taken = set(), set(), []
        for i, r, c in pdf[[row, column]].itertuples():
            taken.append(r not in rows and c not in columns)
            if taken[-1]:
                rows.add(r)
                columns.add(c)
        return pdf[taken]

    near = costs.filter(F.col(cost) <= most)
    return near.groupBy(*keys).applyInPandas(lambda pdf: fold(pdf.sort_values([cost, row, column], kind="stable")), costs.schema)


def _overlap(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection over union of a box with others (x1, y1, x2, y2)."""
    sides = np.minimum(box[2:], others[:, 2:]) - np.maximum(box[:2], others[:, :2])
    both = np.clip(sides, 0, None).prod(axis=1)
    union = (box[2:] - box[:2]).prod() + (others[:, 2:] - others[:, :2]).prod(axis=1) - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def suppress(boxes: DataFrame, keys: list[str], label: str, score: str, limit: float = 0.55) -> DataFrame:
    """boxes (x1, y1, x2, y2) kept by falling score; one that overlaps a kept one of its label by the limit goes."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(pdf)):
            if not kept or (_overlap(xy[i], xy[kept]) < limit).all():
                kept.append(i)
        return pdf.iloc[kept]

    return boxes.groupBy(*keys, label).applyInPandas(lambda pdf: fold(pdf.sort_values([score, "x1", "y1", "x2", "y2"], ascending=[False, True, True, True, True], kind="stable")), boxes.schema)


