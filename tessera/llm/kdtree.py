"""Exact top-k search by inner product (operator 12): KD-trees per shard, best-first by bounds of boxes.

Vectors are turned into whole numbers. Median splits of a bounded sample cut space into cells (the sample decides where the
cuts are, never what is found); a cell that holds more than a shard's worth of vectors is dealt out to several shards by
hash, so a vector with very many copies is many tasks. Every shard has a KD-tree: median splits of the dimension that
spreads most, and a tight bounding box at each node. The largest inner product that a query can have with anything in a box
is the sum over dimensions of the better of its two sides, so a box below the query's kth best score is left out; one that
ties with it is not, since a tie may go to a smaller vec_id.

A query first searches the shard with the best bound. The kth score found there goes with the query to the other shards: only
cells whose boxes reach it are visited at all, and in each tree the search starts from it. Within a tree the queries of a task
walk together, each taking its best open box next.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id; a zero or
an empty vector takes part with score 0; vectors of different lengths are not compared; repeated rows count once, and so does a
vec_id with several vectors, with the best; with fewer than k candidates a query gets all; ties go to the smaller vec_id;
scores are exact whole numbers, and those that a long can't hold become the nearest long; further columns, whatever their
names, are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import small, table, written

K = 20
SCALE = 64
#: The bound of the sample that places the cuts of space, in vectors of each length, and the most cells of a length.
SAMPLE_ROWS = 20_000
MAX_CELLS = 1024
#: Vectors of a shard (at most about; at least, where there are so many), of a tree's leaf, and queries of a task.
SHARD_VECTORS = 32_768
LEAST_SHARD = 1024
LEAF = 256
TASK_QUERIES = 8192
#: Shards' numbers of tasks are broadcast up to so many.
MAX_BROADCAST_SHARDS = 500_000
#: Queries that walk a tree at once.
CHUNK = 512
#: Whole numbers are exact in doubles below this.
EXACT = float(1 << 53)
SEED = 12
_FOUND = "query_id long, vec_id long, score long"
_LONG = np.iinfo(np.int64)


def usable(v: Column) -> Column:
    """A vector of finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(rows: DataFrame) -> DataFrame:
    """The distinct vec_id and v (components times SCALE, rounded down, as doubles that are whole) of the rows that take part."""
    good = rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # rint of what floor would make a long: whole numbers of any size stay doubles.
    down = lambda x: F.when(F.rint(x) > x, F.rint(x) - 1).otherwise(F.rint(x))
    return good.select("vec_id", F.transform("embedding", lambda x: down(x.cast("double") * SCALE) + 0.0).alias("v")).distinct()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def best_possible(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner products (queries x boxes) with anything in the boxes (boxes x dims)."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products (queries x vectors) of whole numbers: as doubles that are exact, else as longs, beyond them the nearest long."""
    bound = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if bound < EXACT:
        return q @ x.T
    whole_numbers = [np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, x)]
    return np.clip(whole_numbers[0] @ whole_numbers[1].T, _LONG.min, _LONG.max).astype(np.int64)


class Tree:
    """A KD-tree over the rows of x: nodes in heap order of their making, each with a tight box; leaves hold stretches of `order`."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        low, high, kids, spans, todo = [], [], [], [], [(0, len(x))]
        for a, b in todo:  # grows while it is walked
            part = self.order[a:b]
            low.append(x[part].min(axis=0))
            high.append(x[part].max(axis=0))
            spans.append((a, b))
            spread = high[-1] - low[-1]
            if b - a <= leaf or not spread.size or not spread.any():  # equal vectors can't be split and need not be
                kids.append(-1)
                continue
            middle = (b - a) // 2
            self.order[a:b] = part[np.argpartition(x[part, spread.argmax()], middle)]
            kids.append(len(todo))
            todo += [(a, a + middle), (a + middle, b)]
        self.low, self.high, self.kids, self.spans = np.array(low), np.array(high), np.array(kids), spans


class Nearest:
    """The k best of each query so far, with the score from which on a candidate matters.

    repeats: whether an id can come with several scores, of which only its best counts.
    """

    def __init__(self, reach: np.ndarray, k: int, repeats: bool = False):
        self.k, self.reach, self.repeats = k, reach.copy(), repeats
        self.scores, self.ids = np.full((len(reach), k), -np.inf), np.full((len(reach), k), _LONG.max)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (at x ids) of candidates; -inf is none."""
        matters = scores >= self.reach[at, None]
        some = matters.any(axis=1)
        cols = np.flatnonzero(matters[some].any(axis=0))
        if not cols.size:
            return
        at, scores, ids = at[some], np.where(matters, scores, -np.inf)[some][:, cols], ids[cols]
        scores = np.concatenate([self.scores[at], scores], axis=1)
        ids = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
        if self.repeats:
            order = np.lexsort((-scores, ids), axis=1)
            ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
            scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
        top = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(ids, top, axis=1)
        self.reach[at] = np.maximum(self.reach[at], self.scores[at, -1])


def walk(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, reach: np.ndarray, k: int) -> Nearest:
    """Best-first search of a tree for many queries: in each step every query opens the box with its best bound.

    reach: for each query a score that k other candidates are known to have (-inf if none is).
    """
    best = Nearest(reach, k, len(np.unique(ids)) < len(ids))
    open_ = np.full((len(q), len(tree.spans)), -np.inf)
    open_[:, :1] = best_possible(q, tree.low[:1], tree.high[:1])
    todo = np.arange(len(q))
    while todo.size:
        node = open_[todo].argmax(axis=1)
        go_on = np.isfinite(bound := open_[todo, node]) & (bound >= best.reach[todo])
        todo, node = todo[go_on], node[go_on]
        open_[todo, node] = -np.inf
        for n in np.unique(node).tolist():
            at, kid = todo[node == n], int(tree.kids[n])
            if kid >= 0:
                open_[at, kid : kid + 2] = best_possible(q[at], tree.low[kid : kid + 2], tree.high[kid : kid + 2])
            else:
                part = tree.order[slice(*tree.spans[n])]
                best.add(at, np.where(qids[at, None] == ids[part], -np.inf, exact_scores(q[at], x[part])), ids[part])
    return best


def _every(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int) -> pd.DataFrame:
    """The search without bounds, for numbers that doubles can't hold exactly."""
    scores, out = exact_scores(q, x), []
    for i, own in enumerate(qids):
        other = np.flatnonzero(ids != own)
        most: dict[int, int] = {}
        for j in other.tolist():
            most[int(ids[j])] = max(int(scores[i, j]), most.get(int(ids[j]), _LONG.min))
        out += [(int(own), j, s) for j, s in sorted(most.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _searched(k: int):
    """The k best in a shard of the queries that visit it."""

    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        if len(asked) and len(shard):
            x, ids = _matrix(shard["v"]), shard["vec_id"].to_numpy(np.int64)
            tree = Tree(x)
            for a in range(0, len(asked), CHUNK):
                part = asked.iloc[a : a + CHUNK]
                q, qids, reach = _matrix(part["v"]), part["vec_id"].to_numpy(np.int64), part["reach"].to_numpy(np.float64)
                if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(x.shape[1], 1) >= EXACT:
                    found.append(_every(x, ids, q, qids, k))
                    continue
                best = walk(tree, x, ids, q, qids, np.where(np.isnan(reach), -np.inf, reach), k)
                good = np.isfinite(best.scores)
                found.append(pd.DataFrame({"query_id": np.repeat(qids, good.sum(axis=1)), "vec_id": best.ids[good], "score": best.scores[good].astype(np.int64)}))
        return pd.concat(found, ignore_index=True)

    return run


class Cuts:
    """Median splits of space, from a sample: a vector's cell is where its walk ends."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dims, self.at = [], []
        parts = [np.unique(sample, axis=0)] if len(sample) else [sample]
        while len(parts) * 2 <= cells:
            dims = [int((p.max(axis=0) - p.min(axis=0)).argmax()) if p.size else 0 for p in parts]
            at = [float(np.median(p[:, d])) if p.size else 0.0 for p, d in zip(parts, dims)]
            parts = [side for p, d, m in zip(parts, dims, at) for side in ((p[p[:, d] <= m], p[p[:, d] > m]) if p.size else (p, p))]
            self.dims.append(np.array(dims))
            self.at.append(np.array(at))

    def cell(self, x: np.ndarray) -> np.ndarray:
        here = np.zeros(len(x), np.int64)
        for dims, at in zip(self.dims, self.at):
            here = here * 2 + (x[np.arange(len(x)), dims[here]] > at[here])
        return here


def _sharded(rows: DataFrame, k: int, every: Column) -> tuple[DataFrame, DataFrame, dict]:
    """Of vectors of one length: entries with shard, queries with cell, and of each cell its shards and box (shards, low, high)."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n = rows.count()
    goal = min(SHARD_VECTORS, max(LEAST_SHARD, -(-n // (2 * tasks))))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()
    cuts = spark.sparkContext.broadcast(Cuts(_matrix(sample["v"]), min(MAX_CELLS, -(-n // goal))))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=cuts.value.cell(_matrix(b["v"])).astype(np.int32))

    rows = written(rows.mapInPandas(placed, "vec_id long, v array<double>, cell int"), "cells")
    # Of equal vectors only the first k + 1 can be among a query's k best.
    first = F.row_number().over(W.partitionBy("cell", "v").orderBy("vec_id"))
    entries = written(rows.withColumn("first", first).filter(F.col("first") <= k + 1).drop("first"), "entries")

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for b in batches:
            for cell, part in b.groupby("cell"):
                x = _matrix(part["v"])
                n, low, high = found.get(cell, (0, np.inf, -np.inf))
                found[cell] = [n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))]
        yield pd.DataFrame([(c, *f) for c, f in found.items()], columns=["cell", "n", "low", "high"])

    seen = written(entries.select("cell", "v").mapInPandas(boxes, "cell int, n long, low array<double>, high array<double>"), "boxes")
    sizes = {r["cell"]: -(-r["n"] // goal) for r in seen.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # MAX_CELLS rows at most
    sides = seen.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("d", "s")).groupBy("cell", "d").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    dims = sides.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("s")).select("cell", "s.low", "s.high")
    box = {r["cell"]: (np.array(r["low"]), np.array(r["high"])) for r in dims.collect()}  # MAX_CELLS rows at most
    cells, first_shard = {}, 0
    for c in sorted(sizes):
        cells[c] = (range(first_shard, first_shard + sizes[c]), *box.get(c, (np.zeros(0), np.zeros(0))))
        first_shard += sizes[c]
    plan = spark.createDataFrame([(c, s.start, len(s)) for c, (s, _, _) in cells.items()], "cell int, first int, cut int")
    entries = entries.join(F.broadcast(plan), "cell").select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "cut").cast("int")).alias("shard"))
    return entries, rows.filter(every).select("vec_id", "v"), cells


def _visits(queries: DataFrame, cells: dict, home: bool) -> DataFrame:
    """queries (vec_id, v, reach and, if not home, at) with shard: the best one of each, or all others that reach allows."""
    shards = [s for s, _, _ in cells.values()]
    shared = queries.sparkSession.sparkContext.broadcast((shards, np.stack([low for _, low, _ in cells.values()]), np.stack([high for _, _, high in cells.values()])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, low, high = shared.value
        for b in batches:
            if not len(b):
                continue
            q, ids = _matrix(b["v"]), b["vec_id"].to_numpy()
            bound = best_possible(q, low, high)
            if home:
                at = bound.argmax(axis=1)
                yield pd.DataFrame({"vec_id": ids, "v": b["v"], "reach": np.nan, "shard": [shards[c][int(i) % len(shards[c])] for c, i in zip(at, ids)]})
                continue
            reach = b["reach"].to_numpy(np.float64)
            # Bounds of numbers beyond EXACT are rounded, so nothing is left out by them.
            rough = np.abs(q).max(axis=1, initial=0)[:, None] * np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0) * max(q.shape[1], 1) >= EXACT
            go = rough | ~(bound < np.where(np.isnan(reach), -np.inf, reach)[:, None])
            for i, (v, at) in enumerate(zip(b["v"], b["at"])):
                to = [s for c in np.flatnonzero(go[i]) for s in shards[c] if s != at]
                if to:
                    yield pd.DataFrame({"vec_id": ids[i], "v": [v] * len(to), "reach": reach[i], "shard": to})

    return queries.mapInPandas(run, "vec_id long, v array<double>, reach double, shard int")


def _asked(entries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's best of every shard that it visits. A shard that many visit is several tasks."""
    batches = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("batches"))
    batches = small(written(batches, "batches"), MAX_BROADCAST_SHARDS)
    left = visits.join(batches, "shard").withColumn("batch", F.pmod(F.xxhash64("vec_id"), "batches").cast("int"))
    right = entries.join(batches, "shard").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    left, right = left.select("shard", "batch", "vec_id", "v", "reach"), right.select("shard", "batch", "vec_id", "v")
    return left.groupBy("shard", "batch").cogroup(right.groupBy("shard", "batch")).applyInPandas(_searched(k), _FOUND)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """Rank among a query's results; a vec_id with several vectors counts once, with its best."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of every row whose vec_id is divisible by `every`, among all other rows."""
    spark = rows.sparkSession
    good = written(whole(rows), "whole-vectors")
    found = spark.createDataFrame([], _FOUND)
    for r in good.groupBy(F.size("v").alias("length")).count().orderBy("length").collect():  # lengths of vectors: few
        entries, queries, cells = _sharded(good.filter(F.size("v") == r["length"]), k, F.pmod("vec_id", F.lit(every)) == 0)
        entries = written(entries, "sharded")
        asked = written(_visits(queries.withColumn("reach", F.lit(None).cast("double")), cells, True), "home")
        near = written(_asked(entries, asked, k), "found")
        # The kth score at home goes with the query; one of several vectors of a vec_id may hold a place there twice.
        reach = _kth(near, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reach"))
        others = asked.select("vec_id", "v", F.col("shard").alias("at")).join(reach, "vec_id", "left")
        visits = written(_visits(others, cells, False), "visits")
        found = found.unionAll(near).unionAll(_asked(entries, visits, k))
    return _kth(found, k)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all embeddings: queries are the rows whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH x AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0))::BIGINT AS score
  FROM x q JOIN x c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
