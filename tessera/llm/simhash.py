"""SimHash near-duplicates (operator 10): BK-trees over fingerprints, one forest for each shard.

Copies collapse first: all that follows works on distinct fingerprints. Fingerprints at r differing bits or fewer agree in
at least one of r + 1 bands, so a shard is what shares a band's value, and every shard gets its own BK-tree: the children
of a node are keyed by their Hamming distance to it, and a search for x at a node at distance d only follows the edges
d - r to d + r. (A tree over all fingerprints would have to be broadcast whole, which has no size bound; a tree goes with its
shard instead.) A shard that outgrows MAX_SHARD is split by the bands of its remaining bits, in one of which any two of its
linked fingerprints agree as well; what is still too large is cut into blocks, and each pair of blocks is a shard, so each
block's tree is sent to all that have to search it. The shards of a partition stream by in runs of HELD_ROWS: the trees of a
run are built and searched together, level by level, in numpy.

A run reports a spanning forest of the links it found, never all pairs of a group: at most one edge less than it
has fingerprints. Connected components are then found by alternating star contractions on those edges.

A ball of radius 3 holds 43 745 fingerprints, which bounds the neighbours of any one fingerprint.

Edge cases: a text without words has fingerprint zero, which links like any other; a null text counts as one without
words; a null doc_id never names a component but its row is linked; repeated rows share their fingerprint's component; a bit
that exactly half of the shingles set is 0; a text of any length is read whole; of equal rows one_of_each keeps the
first by place; further columns are kept by one_of_each, whatever their names (but those that begin with two underscores, which
are its own); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import FILE, ROW, given_back, placed, table, without, written

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Pairs of (search, node) that one step of the tree walk holds at most.
FRONTIER = 1 << 18
#: Fingerprints of a shard at most, and of the shards whose trees a worker holds at once.
MAX_SHARD = 1 << 16
HELD_ROWS = 1 << 18
#: Shards to be split are broadcast up to so many.
MAX_BROADCAST_SHARDS = 500_000


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is set in more than half of the shingles' hashes."""
    parts = (text or "").encode().lower().split()  # bytes: A to Z only, ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    k = min(words, len(parts))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(parts) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    with given_back():
        texts = None
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        texts = None


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with __fp (64 bits, as a long)."""
    return docs.withColumn("__fp", _fingerprints("text"))


class Forest:
    """BK-trees over groups of distinct fingerprints, one tree a group, built and searched for all groups at once."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group: sorted numbers from 0; value: uint64, no value twice in a group."""
        n = len(value)
        self.value = value
        first = np.r_[True, group[1:] != group[:-1]]
        self.root_of = np.flatnonzero(first)[group]
        parent, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        here, at = np.flatnonzero(~first), self.root_of[~first]
        while len(here):  # what hangs below the same edge: the first becomes the child, the others go on below it
            d = np.bitwise_count(value[here] ^ value[at]).astype(np.int64)
            edge = at * 65 + d
            order = np.argsort(edge, kind="stable")
            here, edge = here[order], edge[order]
            head = np.r_[True, edge[1:] != edge[:-1]]
            child = here[np.flatnonzero(head)[np.cumsum(head) - 1]]
            parent[here[head]], key[here[head]] = edge[head] // 65, edge[head] % 65
            here, at = here[~head], child[~head]
        kids = np.flatnonzero(parent >= 0)
        edge = parent[kids] * 65 + key[kids]
        order = np.argsort(edge)
        self.edge, self.kid = edge[order], kids[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y), x < y in position, whose values differ in at most radius bits; each pair once."""
        todo = [(np.arange(a, min(len(self.value), a + (FRONTIER >> 2))), None) for a in range(0, len(self.value), FRONTIER >> 2)][::-1]
        while todo:
            x, node = todo.pop()
            node = self.root_of[x] if node is None else node
            d = np.bitwise_count(self.value[x] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (x < node)
            if hit.any():
                yield x[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right") - low
            for part in self._parts(count):  # so that no step holds more than FRONTIER pairs, but for one search's own
                c = count[part]
                if total := int(c.sum()):
                    start = np.repeat(low[part] - np.r_[0, np.cumsum(c)[:-1]], c)
                    todo.append((np.repeat(x[part], c), self.kid[start + np.arange(total)]))

    @staticmethod
    def _parts(count: np.ndarray) -> list[slice]:
        cuts = np.searchsorted(np.cumsum(count), np.arange(FRONTIER, int(count.sum()) + 1, FRONTIER))
        edges = [0, *sorted(set(cuts.tolist()) - {0}), len(count)]
        return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links: union-find over positions, within a batch one link for each pair of sets."""
    up, kept = np.arange(n), []

    def top(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return int(a)

    for x, y in links:
        while not np.array_equal(flat := up[up], up):
            up[:] = flat
        sets = np.minimum(up[x], up[y]) * n + np.maximum(up[x], up[y])
        _, one = np.unique(sets, return_index=True)
        for i in one[up[x[one]] != up[y[one]]]:
            a, b = top(x[i]), top(y[i])
            if a != b:
                up[max(a, b)] = min(a, b)
                kept.append((int(x[i]), int(y[i])))
    return kept


def _forest_of(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Edges a, b of a spanning forest of the links inside the shards (band, pair) of the rows."""
    fp = rows["fp"].to_numpy(np.int64)
    _, group, size = np.unique(rows[["band", "pair"]].to_numpy(np.int64), axis=0, return_inverse=True, return_counts=True)
    more = size[group] > 1
    group, fp = group[more], fp[more]
    order = np.argsort(group, kind="stable")
    _, group = np.unique(group[order], return_inverse=True)
    fp = fp[order]
    distinct, number = np.unique(fp, return_inverse=True)  # a fingerprint may be in several shards here
    edges = ((number[x], number[y]) for x, y in Forest(group, fp.view(np.uint64)).links(radius)) if len(fp) else iter(())
    forest = np.array(_spanning(len(distinct), edges), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": distinct[forest].min(axis=1), "b": distinct[forest].max(axis=1)})


def _shard_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for rows in batches:
            held.append(rows)
            n += len(rows)
            if n >= HELD_ROWS:
                rows = pd.concat(held, ignore_index=True)
                open_ = (rows["band"] == rows["band"].iloc[-1]) & (rows["pair"] == rows["pair"].iloc[-1])  # may go on in the next batch
                if not open_.all():
                    yield _forest_of(rows[~open_], radius)
                held = [rows[open_]]
                n = len(held[0])
        if n:
            yield _forest_of(pd.concat(held, ignore_index=True), radius)

    def freed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with given_back():
            yield from run(batches)

    return freed


def _bits(value: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << n) - 1)) if start < 64 else F.lit(0).cast("long")


def _bands(value: Column, bits: int, bands: int) -> list[Column]:
    """The values of the bands of a value of so many bits, each with its band's number."""
    width = -(-bits // bands)
    return [_bits(value, i * width, min(width, bits - i * width)) * bands + i for i in range(bands)]


def _rest(band: int, width: int) -> Column:
    """The fingerprint without the bits of a band."""
    above = F.shiftleft(_bits(F.col("fp"), (band + 1) * width, 64 - (band + 1) * width), band * width) if (band + 1) * width < 64 else F.lit(0).cast("long")
    return above.bitwiseOR(_bits(F.col("fp"), 0, band * width)) if band else above


def _too_large(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The shards (keys) of more than MAX_SHARD rows, and their n; None if there are none."""
    large = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_SHARD), "large-shards")
    n = large.count()
    return None if not n else F.broadcast(large) if n <= MAX_BROADCAST_SHARDS else large


def shards(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """band, pair and fp: shards of bounded size, such that linked fingerprints share one at least."""
    bands = radius + 1
    width = -(-64 // bands)
    spread = prints.select("fp", F.explode(F.array(*_bands(F.col("fp"), 64, bands))).alias("band"))
    large = _too_large(spread, ["band"])
    if large is None:
        return spread.withColumn("pair", F.lit(0).cast("long"))
    spread = spread.join(large, "band", "left")
    small = spread.filter("n IS NULL").select("fp", "band", F.lit(0).cast("long").alias("pair"))
    inner = [F.array(*_bands(_rest(i, width), 64 - width, bands)) for i in range(bands)]
    second = F.explode(F.get(F.array(*inner), F.pmod("band", F.lit(bands)).cast("int")))
    again = spread.filter("n IS NOT NULL").select("fp", "band", second.alias("pair")).withColumn("pair", F.col("pair") + 1)
    large = _too_large(again, ["band", "pair"])
    if large is None:
        return small.unionByName(again)
    again = again.join(large, ["band", "pair"], "left")
    small = small.unionByName(again.filter("n IS NULL").drop("n"))
    # Pairs (i, j) of blocks, i <= j: a fingerprint of block k is in all pairs with k.
    blocks = F.ceil(F.col("n") * 2 / MAX_SHARD)
    cut = again.filter("n IS NOT NULL").withColumn("blocks", blocks).withColumn("k", F.pmod(F.xxhash64("fp"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return small.unionByName(cut.select("fp", "band", F.xxhash64("pair", F.least("k", "other"), F.greatest("k", "other")).alias("pair")))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that differ in at most radius bits."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = shards(prints, radius).select("band", "pair", "fp").repartition(n, "band", "pair").sortWithinPartitions("band", "pair")
    return spread.mapInPandas(_shard_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of the edges (a, b), by alternating star contractions.

    Each round is two aggregations over the edges, which never grow in number; chains shorten by a factor a round.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before they are joined, so that the join can split a star's centre.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")  # all larger neighbours hang on the least
        large = written(large.filter("a <> b").distinct(), "large")
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        after = written(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        done = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if done:
            roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _resolved(docs: DataFrame, radius: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, fp, root (smallest fingerprint of the component) and component_id of every document."""
    rows = written(with_fingerprint(docs.select("doc_id", "text", *keep)).select("doc_id", *keep, F.col("__fp").alias("fp")), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(prints, radius))
    linked = found.join(prints, found["node"] == prints["fp"]).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("node", "root", "least")
    named = prints.join(linked, prints["fp"] == linked["node"], "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    return rows.join(written(named, "components"), "fp")  # joined by itself, so that a fingerprint of very many rows can be split


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of every document."""
    return _resolved(docs, radius).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (of several, or of rows without one, the first by place).

    Rows are told apart by their places in their files. What goes is sent to where the documents lie, whose texts are read
    twice and never exchanged.
    """
    docs = placed(docs)
    found = written(_resolved(docs, radius, (FILE, ROW)).select("doc_id", "root", FILE, ROW), "resolved")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", FILE, ROW)).alias("x")
    stays = written(found.groupBy("root").agg(first).select(f"x.{FILE}", f"x.{ROW}"), "stays")
    return without(docs, found.select(FILE, ROW).join(stays, [FILE, ROW], "left_anti"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents: three-word shingles, links at three differing bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"))
