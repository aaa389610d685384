"""Approximate nearest neighbours (operator 9): inverted lists with product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on the driver on a bounded sample. Every vector then gets the list of
its nearest centroid and, for each part of its residual, the nearest codeword. A query visits the lists of the centroids it
has the largest inner products with, scores their vectors by table look-ups (query part times codeword, precomputed), and
the best of each block are scored exactly on the original vectors, in double precision.

How many lists a query visits follows the data: on the sample, it is the share of the lists (in the order of their centroids)
that holds RECALL_GOAL of the sample's own nearest neighbours, so few lists where vectors cluster and most of them where they
are spread evenly.

A check follows, as a sample and codes are no guide to rows of very unequal lengths, to close copies, which share their codes, or
to groups that the sample missed. The kth best of a query in the sample is a floor; a list is visited as well if its centroid's
product and its radius can reach the floor, and a vector of a visited list is scored exactly as well if its coded score and the
distance from its code can reach the kth best known. Both bounds are Cauchy-Schwarz's, so no nearest vector is lost.

Lists are packed into blocks of bounded size, and a list that is larger is cut into several, so a list with a third of all
vectors is many tasks. Queries go to the blocks that they visit; a block that more queries visit than one task should answer
is dealt out to several, and only that block's vectors are repeated. In a task the block lies in memory and the queries
stream by. Equal vectors are one entry with its vec_ids in order; only the first k + 1 of them can be among a query's k
nearest, ties going to the smaller vec_id, so no more of them go to the search.

Inner products need vectors of one length. Those of the commonest length are indexed; queries and candidates of any other
length are compared exactly among themselves, in blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a
vec_id; repeated rows count once, and so does a vec_id with several vectors, with the best; with fewer than k candidates a
query gets all; ties go to the smaller vec_id; further columns, whatever their names, are neither read nor returned; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, written

K = 20
#: The bound of the fitting sample, in vectors.
TRAIN_ROWS = 20_000
MAX_LISTS = 1024
PARTS = 16
CODEWORDS = 256
#: Share of the sample's nearest neighbours that the visited lists hold, by how many queries of the sample it is measured, and
#: how many vectors a query sees at least, in multiples of k.
RECALL_GOAL = 0.97
GAUGE_ROWS = 400
LEAST_SEEN = 40
#: Vectors of a block that are scored exactly for a query before the check. Where more pairs of a query and a vector than
#: MANY_PAIRS may pass it, products of whole blocks thin them out; so many at once are scored.
SHORTLIST = 160
MANY_PAIRS = 1 << 16
#: What rounding may add to a product or a distance, relative to the lengths that go into it.
SLACK = 1e-12
#: Most vectors of a block, most queries that meet it in one task, and how many of those are scored at once.
BLOCK_VECTORS = 16384
BLOCK_QUERIES = 65536
CHUNK = 256
SEED = 11


@dataclass
class Codec:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # parts x codewords x width
    probes: int = 1  # lists that a query visits
    known: tuple[np.ndarray, np.ndarray] | None = None  # the sample, one vector a vec_id

    def split(self, x: np.ndarray) -> np.ndarray:
        """n x parts x width; the last part is filled up with zeros."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the distances of the vectors from their centroids and from their codes, at most."""
        lists = _nearest(x, self.centroids)
        centres = self.centroids[lists]
        rest = self.split(x - centres)
        codes = np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)
        coded = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        slack = SLACK * (_length(centres) + _length(x) + np.linalg.norm(coded, axis=2).sum(axis=1))
        return lists, codes, _length(x - centres) + slack, _length((rest - coded).reshape(len(x), -1)) + slack

    def floors(self, queries: np.ndarray, qids: np.ndarray, k: int) -> np.ndarray:
        """What the kth nearest of each query scores at least: the kth best of the sample."""
        out, (ids, x) = np.full(len(queries), -np.inf), self.known
        for a in range(0, len(queries) if len(ids) >= k else 0, CHUNK):
            q = queries[a : a + CHUNK]
            score = q @ x.T - SLACK * np.outer(_length(q), _length(x))
            score[(qids[a : a + CHUNK, None] == ids) | np.isnan(score)] = -np.inf
            out[a : a + CHUNK] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        return out


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means; a centre without vectors stays where it is."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def fit(sample: np.ndarray, n_lists: int, seed: int = SEED, k: int = K) -> Codec:
    rng, sample = np.random.default_rng(seed), np.unique(sample, axis=0)  # copies of a vector teach nothing
    centroids = _means(sample, n_lists, rng)
    parts = min(PARTS, sample.shape[1])
    width = -(-sample.shape[1] // parts)
    codec = Codec(centroids, np.zeros((parts, 1, width)))
    rest = codec.split(sample - centroids[_nearest(sample, centroids)])
    books = np.zeros((parts, CODEWORDS, width))
    for m in range(parts):
        book = _means(rest[:, m], CODEWORDS, rng)
        books[m] = np.concatenate([book, np.repeat(book[:1], CODEWORDS - len(book), axis=0)])
    return Codec(centroids, books, _probes_for(sample, centroids, k, rng))


def _probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """How many lists hold RECALL_GOAL of the k nearest, in the order in which queries visit lists."""
    chosen = rng.permutation(len(sample))[:GAUGE_ROWS]
    near = sample[chosen] @ sample.T
    near[np.arange(len(chosen)), chosen] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    if not top.size:
        return len(centroids)
    place = np.argsort(np.argsort(-(sample[chosen] @ centroids.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, _nearest(sample, centroids)[top], axis=1), RECALL_GOAL, method="higher")) + 1


def usable(v: Column) -> Column:
    """A vector of finite components, not all of them 0."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def vectors(rows: DataFrame) -> DataFrame:
    """The distinct rows (vec_id, embedding) that take part."""
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()


def index(rows: DataFrame, seed: int = SEED, k: int = K) -> tuple[DataFrame, Codec | None, int]:
    """Every one of the vectors, which have one length, with its list, codes and distances (far: from the centroid, off: from
    the code); the codec; their number."""
    good = rows
    n = good.count()
    if not n:
        return good.withColumns({"list": F.lit(0), "codes": F.lit(b""), "far": F.lit(0.0), "off": F.lit(0.0)}), None, 0
    sample = good.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(TRAIN_ROWS).select("vec_id", "embedding").toPandas()
    codec = fit(_matrix(sample["embedding"]), max(1, min(MAX_LISTS, round(n**0.5))), seed, k)
    shared = rows.sparkSession.sparkContext.broadcast(codec)  # 1024 centroids and 256 x 16 codewords at most

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                lists, codes, far, off = shared.value.encode(_matrix(b["embedding"]))
                yield b.assign(list=lists.astype(np.int32), codes=[c.tobytes() for c in codes], far=far, off=off)

    kind = good.schema["embedding"].dataType.simpleString()
    encoded = good.mapInPandas(encode, f"vec_id long, embedding {kind}, list int, codes binary, far double, off double")
    single = sample.drop_duplicates("vec_id")
    return written(encoded, "index"), replace(codec, known=(single["vec_id"].to_numpy(np.int64), _matrix(single["embedding"]))), n


def _blocks(sizes: dict[int, int]) -> dict[int, range]:
    """The blocks of each list: small lists share one, a large one is cut."""
    out, block, held = {}, 0, 0
    for i, n in sorted(sizes.items()):
        if n > BLOCK_VECTORS:
            block += held > 0
            out[i], held = range(block, block - (-n // BLOCK_VECTORS)), 0
            block = out[i].stop
            continue
        if held + n > BLOCK_VECTORS:
            block, held = block + 1, 0
        out[i], held = range(block, block + 1), held + n
    return out


def _probes(queries: DataFrame, codec: Codec, sizes: dict[int, int], radii: dict[int, float], blocks: dict[int, range], k: int) -> DataFrame:
    """query_id, q, floor, block and lists: the blocks that each query visits, and which lists there."""
    held = np.array([sizes.get(i, 0) for i in range(len(codec.centroids))])
    radius = np.array([radii.get(i, 0.0) for i in range(len(codec.centroids))])
    inside: dict[int, list[int]] = {}
    for i, where in blocks.items():
        for b in where:
            inside.setdefault(b, []).append(i)
    lists_of = {b: np.array(x, np.int32) for b, x in inside.items()}
    shared = queries.sparkSession.sparkContext.broadcast((codec, held, radius, lists_of))  # 1024 lists and TRAIN_ROWS vectors at most

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, held, radius, lists_of = shared.value
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["embedding"])
            near, floors = x @ codec.centroids.T, codec.floors(x, b["vec_id"].to_numpy(np.int64), k)
            order = np.argsort(-near, axis=1, kind="stable")
            seen = np.cumsum(held[order], axis=1)
            stop = np.maximum(codec.probes, (seen < LEAST_SEEN * k).sum(axis=1) + 1)
            reach = ~(near + _length(x)[:, None] * radius < floors[:, None])  # also where a product is no number
            out = []
            for key, q, floor, visited, o, s in zip(b["vec_id"], b["embedding"], floors, reach, order, stop):
                visited[o[:s]] = True
                out += [(key, q, floor, block, lists[visited[lists]]) for block, lists in lists_of.items() if visited[lists].any()]
            yield pd.DataFrame(out, columns=["query_id", "q", "floor", "block", "lists"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInPandas(visit, f"query_id long, q {kind}, floor double, block int, lists array<int>")


_FOUND = "query_id long, vec_id long, score double"


def _best(qids: np.ndarray, at: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query's scored candidates, a vec_id once: at (the query's place), ids and exact side by side; -inf is none."""
    good = np.flatnonzero(np.isfinite(exact))
    good = good[np.lexsort((ids[good], -exact[good], at[good]))]
    good = good[~pd.DataFrame({"at": at[good], "id": ids[good]}).duplicated().to_numpy()]
    good = good[np.arange(len(good)) - np.searchsorted(at[good], at[good]) < k]
    return pd.DataFrame({"query_id": qids[at[good]], "vec_id": ids[good], "score": exact[good]})


class _Block:
    """A block's vectors: coded for the first look, whole for the second."""

    def __init__(self, rows: pd.DataFrame, codec: Codec):
        rows = rows.sort_values("vec_id", ignore_index=True)
        self.codec, self.ids, self.x = codec, rows["vec_id"].to_numpy(np.int64), _matrix(rows["embedding"])
        self.lists = rows["list"].to_numpy(np.int64)
        self.codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        self.off, self.length, self.single = rows["off"].to_numpy(), _length(self.x), rows["vec_id"].is_unique

    def answer(self, part: pd.DataFrame, k: int) -> pd.DataFrame:
        codec, take = self.codec, min(SHORTLIST, len(self.ids))
        queries, qids = _matrix(part["embedding"]), part["vec_id"].to_numpy(np.int64)
        # Asymmetric: the query is exact, the vector coded. Its list's centroid, then each part by table.
        tables = np.einsum("nmw,mkw->mnk", codec.split(queries), codec.books)
        near = (queries @ codec.centroids.T)[:, self.lists]
        for m, t in enumerate(tables):
            near += t[:, self.codes[:, m]]
        visited = np.zeros((len(part), len(codec.centroids)), bool)
        for i, seen in enumerate(part["lists"]):
            visited[i, seen] = True
        open_ = visited[:, self.lists] & (qids[:, None] != self.ids)
        near[~open_] = -np.inf
        short = np.sort(np.argpartition(-near, take - 1, axis=1)[:, :take], axis=1)
        exact = np.where(np.take_along_axis(open_, short, axis=1), (self.x[short] * queries[:, None, :]).sum(axis=2), -np.inf)
        # The check: what may reach the kth best that is known.
        least = part["floor"].to_numpy(np.float64)
        if self.single and take >= k:
            least = np.fmax(least, np.partition(exact, take - k, axis=1)[:, take - k])
        np.put_along_axis(open_, short, False, axis=1)
        length = _length(queries)[:, None]
        near += length * self.off
        open_ &= ~(near < least[:, None])
        if np.count_nonzero(open_) > MANY_PAIRS:
            open_ &= ~(queries @ self.x.T + SLACK * length * self.length < least[:, None])
        at, more = np.nonzero(open_)
        scores = [(self.x[more[a : a + MANY_PAIRS]] * queries[at[a : a + MANY_PAIRS]]).sum(axis=1) for a in range(0, len(at), MANY_PAIRS)]
        at = np.concatenate([np.repeat(np.arange(len(part)), take), at])
        return _best(qids, at, self.ids[np.concatenate([short.ravel(), more])], np.concatenate([exact.ravel(), *scores]), k)


def _search(k: int, shared):
    """Answers rows in the order of (block, batch, query): first a block's vectors, then the queries that visit it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, at, held, block = shared.value, None, [], None
        for rows in batches:
            for key, group in rows.groupby(["block", "batch"], sort=False):
                if key != at:
                    at, held, block = key, [], None
                is_query = group["query"].to_numpy(bool)
                if not is_query.all():
                    held.append(group[~is_query])
                asked = group[is_query]
                if len(asked) and held:
                    block = block or _Block(pd.concat(held), codec)
                    for a in range(0, len(asked), CHUNK):
                        yield block.answer(asked.iloc[a : a + CHUNK], k)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A vec_id with several vectors counts once, with its best."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(indexed: DataFrame, codec: Codec, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, vec_id, score: each query's best of every block that it visits. queries: vec_id and embedding."""
    spark = indexed.sparkSession
    first = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    entries = written(indexed.withColumn("n", first).filter(F.col("n") <= k + 1).drop("n"), "entries")
    lists = entries.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a list
    sizes, radii = {r["list"]: r["n"] for r in lists}, {r["list"]: r["far"] for r in lists}
    blocks = _blocks(sizes)
    plan = spark.createDataFrame([(i, b.start, len(b)) for i, b in blocks.items()], "list int, first int, cut int")
    left = written(_probes(queries, codec, sizes, radii, blocks, k), "probes")
    batches = left.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("batches"))  # a row a block
    left = left.join(batches, "block").withColumn("batch", F.pmod(F.xxhash64("query_id"), "batches").cast("int"))
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), "cut").cast("int")
    right = entries.join(F.broadcast(plan), "list").withColumn("block", block).join(batches, "block")  # plan: a row a list
    right = right.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    left = left.select("block", "batch", F.lit(True).alias("query"), F.col("query_id").alias("vec_id"), F.col("q").alias("embedding"), "lists", "floor", F.lit(0).alias("list"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("off"))
    right = right.select("block", "batch", F.lit(False).alias("query"), "vec_id", "embedding", F.lit(None).cast("array<int>").alias("lists"), F.lit(0.0).alias("floor"), "list", "codes", "off")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = left.unionAll(right).repartition(tasks, "block", "batch").sortWithinPartitions("block", "batch", "query")
    return both.mapInPandas(_search(k, spark.sparkContext.broadcast(replace(codec, known=None))), _FOUND)


def _compare(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(q) and len(c):
            ids, x = c["vec_id"].to_numpy(np.int64), _matrix(c["embedding"])
            for a in range(0, len(q), CHUNK):
                part = q.iloc[a : a + CHUNK]
                qids = part["query_id"].to_numpy(np.int64)
                exact = (x[None] * _matrix(part["q"])[:, None, :]).sum(axis=2)
                exact[qids[:, None] == ids] = -np.inf
                at = np.repeat(np.arange(len(part)), len(ids))
                found.append(_best(qids, at, np.tile(ids, len(part)), exact.ravel(), k))
        return pd.concat(found, ignore_index=True)

    return run


def exact_search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, vec_id, score: each query's best of every block of the rows of its length. Both: vec_id, embedding."""
    size = F.size("embedding").alias("length")
    counts = rows.groupBy(size).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SIDE).cast("int").alias("blocks"))
    asked = queries.groupBy(size).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SIDE).cast("int").alias("batches"))
    sides = written(counts.join(asked, "length"), "lengths")
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), size).join(sides, "length").withColumn("batch", F.pmod(F.xxhash64("query_id"), "batches").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rows.select("vec_id", "embedding", size).join(sides, "length").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    keys = ["length", "block", "batch"]
    return left.select(*keys, "query_id", "q").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInPandas(_compare(k), _FOUND)


#: Rows of either side of a task that compares exactly.
BLOCK_SIDE = 4096


def nearest(rows: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, among all other rows of its length."""
    spark = rows.sparkSession
    good = written(vectors(rows), "vectors")
    lengths = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    most = F.size("embedding") == lengths[0]["n"]
    indexed, codec, _ = index(good.filter(most), k=k)
    found = search(indexed, codec, indexed.filter(asked).select("vec_id", "embedding"), k)
    if len(lengths) > 1:
        others = good.filter(~most)
        found = found.unionAll(exact_search(others, others.filter(asked), k))
    return _ranked(found, k)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all embeddings: queries are the rows whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
