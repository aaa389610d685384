"""Merkle manifest of a dataset (operator 11): contiguous digest matrices, hashed level by level in aligned blocks.

A leaf is the SHA-256 of a document's fields, computed by Spark. The leaves of a language ascend by doc_id and are numbered:
narrow rows go through one range exchange, each partition counts its own, and prefix sums of those counts give every leaf its
position, so no language, however large, is one task. An aligned block of fanout ** LEVELS positions is a matrix of 64 bytes a
row; a run of fanout rows is one stretch of its bytes, so a level is hashed by walking over stretches, and left and right
siblings of any node at any level are stretches whose ends follow from the position alone.

The tops of the blocks are the nodes of the next round, numbered by their block; rounds go on until every language has one
top, its subroot. The subroots are numbered and climbed in the same way to the root. On the way down a block's path (for each
level above it the siblings to its left and to its right) is made from the path of the block above it, so a leaf's proof needs
its own block and one path.

Edge cases: a null field is `-` in the leaf, unlike an empty one (`0:`); a null lang is a tree of its own, first of all; a null
doc_id comes first in its tree and is never tampered with; rows of one doc_id are ordered by their leaves, and equal rows
have equal leaves, whose order shows in nothing but their proofs; a tree of one leaf has that leaf as its subroot, and a
single document has itself as root and the digest of nothing as proof; a text of any length is read whole; further columns,
whatever their names, are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, small, table, written

FANOUT = 8
#: Levels that are hashed within a block: it has FANOUT ** LEVELS nodes (256 KB of digests).
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stretches of partitions, and trees, are broadcast up to so many rows.
MAX_BROADCAST_ROWS = 100_000
HEX = 64
_NODE = "tree string, n long, pos long, digest string"
_PATH = "tree string, block long, path array<string>"


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf(**changed: Column) -> Column:
    """Digest of a document's fields: `-` for a null, else the count of its UTF-8 bytes, a colon and the value."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


class Block:
    """The nodes of one aligned block and all levels above them that lie inside it."""

    def __init__(self, digests: list[str], of: int, fanout: int = FANOUT, levels: int = LEVELS):
        """digests: the block's nodes in order; of: how many nodes their tree has on this level."""
        self.fanout, self.levels = fanout, [np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)]
        while of > 1 and len(self.levels) <= levels:
            below, of = self.levels[-1], -(-of // fanout)
            data, run = below.tobytes(), HEX * fanout
            above = b"".join([_sha(data[a : a + run]) for a in range(0, len(data), run)])
            self.levels.append(np.frombuffer(above, np.uint8).reshape(-1, HEX))

    @property
    def top(self) -> str:
        return self.levels[-1][0].tobytes().decode()

    def siblings(self) -> Iterator[list[tuple[bytes, bytes]]]:
        """For each node the digests to the left and to the right of its ancestor on each level, within the run."""
        data = [m.tobytes() for m in self.levels[:-1]]
        at = np.arange(len(self.levels[0]))
        ends = []
        for bytes_, m in zip(data, self.levels):
            first = at // self.fanout * self.fanout
            last = np.minimum(first + self.fanout, len(m))
            ends.append((bytes_, *[(x * HEX).tolist() for x in (first, at, at + 1, last)]))
            at = at // self.fanout
        for i in range(len(self.levels[0])):
            yield [(b[first[i] : own[i]], b[next_[i] : last[i]]) for b, first, own, next_, last in ends]


def fold(digest: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and the siblings of its ancestors give."""
    for left, right in siblings:
        digest = _sha(left + digest + right)
    return digest


def _joined(siblings: list[tuple[bytes, bytes]]) -> list[str]:
    return [f"{left.decode()}|{right.decode()}" for left, right in siblings]


def _parted(path) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode() for x in step.split("|")) for step in path]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with a column tree) with pos, their place in their tree by these columns, from 0, and n, the tree's size; written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "tie"]  # equal rows are told apart, so that very many of them are several partitions
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)
    # Numbered in the order of the partition: the low 33 bits of this id count a partition's rows.
    rows = written(rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("tie"), "ordered")
    runs = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(W.partitionBy("tree")).alias("n"))
    runs = small(written(runs, "runs"), MAX_BROADCAST_ROWS)  # a row for each tree of a partition
    return rows.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, fanout: int, levels: int):
    return nodes.groupBy("tree", F.expr(f"pos div {fanout**levels}").alias("block"))


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of numbered nodes (tree, n, pos, digest): the root of each tree (tree, digest), and of each block of the nodes its path.

    A path has a string for each level above the block: the siblings to the left, a bar, and those to the right.
    """
    size = fanout**levels

    def tops(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos"), int(rows["n"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "n": [-(-n // size)], "pos": [key[1]], "digest": [Block(rows["digest"].tolist(), n, fanout, levels).top]})

    def paths(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        if rows.empty:
            return pd.DataFrame({"tree": [], "block": [], "path": []})
        rest = list(above["path"].iloc[0])
        own = Block(rows["digest"].tolist(), int(rows["n"].iloc[0]), fanout, levels).siblings()
        return pd.DataFrame({"tree": key[0], "block": rows["pos"], "path": [_joined(s) + rest for s in own]})

    found = written(_blocks(nodes.select("tree", "n", "pos", "digest"), fanout, levels).applyInPandas(tops, _NODE), "tops")
    done = found.filter("n = 1")
    ends = done.select("tree", F.col("pos").alias("block"), F.array().cast("array<string>").alias("path"))
    if found.filter("n > 1").isEmpty():
        return done.select("tree", "digest"), ends
    more = found.filter("n > 1")
    roots, above = climb(more, fanout, levels)
    inner = _blocks(more, fanout, levels).cogroup(above.groupBy("tree", "block")).applyInPandas(paths, _PATH)
    return done.select("tree", "digest").unionAll(roots), written(ends.unionAll(inner), "paths")


def _proofs(fanout: int, levels: int):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of the leaves of one block."""

    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
        rest = _parted(above["path"].iloc[0])
        tail = b"".join([x for pair in rest for x in pair])
        proof, folded = [], []
        for start, own in zip(rows["tampered"], Block(rows["digest"].tolist(), int(rows["n"].iloc[0]), fanout, levels).siblings()):
            proof.append(hashlib.sha256(b"".join([x for pair in own for x in pair]) + tail).hexdigest())
            folded.append(fold(fold(start.encode(), own), rest).decode())
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "leaf": rows["digest"], "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


def manifest(docs: DataFrame, tampered: DataFrame | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    docs has the columns of FIELDS and, if wanted, `tampered`: the digest that is folded up in place of the leaf.
    """
    found = F.coalesce("tampered", "digest") if "tampered" in docs.columns else F.col("digest")
    # lang behind a letter, so that null (nothing) stands before every lang, the empty one too.
    rows = docs.withColumn("digest", leaf()).select("doc_id", F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("")).alias("tree"), "digest", found.alias("tampered"))
    rows = written(rows, "leaves")  # narrow: texts are read once and not moved
    leaves = written(numbered(rows, "doc_id", "digest"), "leaves")
    subroots, paths = climb(leaves, fanout, levels)
    subroots = written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), "subroots")
    tops = written(numbered(subroots, "lang"), "subroots")
    roots, upper = climb(tops, fanout, levels)

    def chained(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        rest = list(above["path"].iloc[0])
        own = Block(rows["digest"].tolist(), int(rows["n"].iloc[0]), fanout, levels).siblings()
        return pd.DataFrame({"top": key[0], "tree": rows["lang"], "subroot": rows["digest"], "upper": [_joined(s) + rest for s in own]})

    blocks = _blocks(tops, fanout, levels).cogroup(upper.groupBy("tree", "block"))
    trees = blocks.applyInPandas(chained, "top string, tree string, subroot string, upper array<string>")
    root = F.broadcast(roots.select(F.col("tree").alias("top"), F.col("digest").alias("root")))  # one row
    trees = small(written(trees.join(root, "top").drop("top"), "trees"), MAX_BROADCAST_ROWS)
    paths = paths.join(trees, "tree").select("tree", "block", "subroot", "root", F.concat("path", "upper").alias("path"))
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocks(leaves, fanout, levels).cogroup(paths.groupBy("tree", "block")).applyInPandas(_proofs(fanout, levels), out)


def with_tampering(docs: DataFrame) -> DataFrame:
    """docs' FIELDS with `tampered`: the leaf with A to Z of the text in lower case, for a third of the doc_ids."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(*FIELDS, F.when(chosen, leaf(text=ascii_lower(F.col("text")))).alias("tampered"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all documents: a tree of fanout 8 a language, and one over the languages."""
    return manifest(with_tampering(table(spark, sf_dir, "documents")))


_SQL_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({{{c}}}::VARCHAR)::VARCHAR || ':' || {{{c}}}::VARCHAR, '-')" for c in FIELDS) + ")"
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _sql_climb(name: str, start: str) -> str:
    """A recursive table name (tree, lvl, pos, digest) over `start` (tree, pos, digest): all levels of all trees."""
    return f"""{name} AS (
  SELECT tree, 0 AS lvl, pos, digest FROM {start}
  UNION ALL
  SELECT tree, lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos)) FROM (
    SELECT tree, lvl, pos, digest, count(*) OVER (PARTITION BY tree) AS c FROM {name}) WHERE c > 1 GROUP BY tree, lvl, pos // {FANOUT})"""


def _sql_sides(nodes: str, levels: str) -> str:
    """For each node (r, tree, pos) and level with siblings below the root: those to the left and to the right."""
    own = f"n.pos // ({FANOUT} ** v.lvl)::BIGINT"
    return f"""SELECT r, v.lvl, coalesce(string_agg(v.digest, '' ORDER BY v.pos) FILTER (v.pos < {own}), '') AS l, coalesce(string_agg(v.digest, '' ORDER BY v.pos) FILTER (v.pos > {own}), '') AS g
  FROM {nodes} n JOIN {levels} v ON n.tree = v.tree AND v.pos // {FANOUT} = n.pos // ({FANOUT} ** (v.lvl + 1))::BIGINT
  WHERE v.lvl < (SELECT max(lvl) FROM {levels} x WHERE x.tree = n.tree) GROUP BY r, v.lvl"""


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('l' || lang, '') AS tree, {_SQL_LEAF.format(**{c: c for c in FIELDS})} AS digest,
         CASE WHEN {_SQL_CRC} % 3 = 0 THEN {_SQL_LEAF.format(**{c: c for c in FIELDS} | {"text": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"})} END AS tampered
  FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM d),
{_sql_climb("low", "leaf")},
sub AS (SELECT tree AS lang, digest, row_number() OVER (ORDER BY tree) AS r, row_number() OVER (ORDER BY tree) - 1 AS pos, '' AS tree FROM low l WHERE lvl = (SELECT max(lvl) FROM low x WHERE x.tree = l.tree)),
{_sql_climb("high", "sub")},
low_sides AS ({_sql_sides("leaf", "low")}),
high_sides AS ({_sql_sides("sub", "high")}),
sides AS (
  SELECT r, lvl, l, g FROM low_sides
  UNION ALL SELECT leaf.r, 1000 + h.lvl, h.l, h.g FROM leaf JOIN sub ON leaf.tree = sub.lang JOIN high_sides h ON h.r = sub.r),
steps AS (SELECT r, l, g, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step FROM sides),
proof AS (SELECT r, string_agg(l || g, '' ORDER BY step) AS p, max(step) AS height FROM steps GROUP BY r),
folded AS (
  SELECT r, 0 AS step, coalesce(tampered, digest) AS digest FROM leaf
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.l || f.digest || s.g) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step + 1),
root AS (SELECT digest FROM high ORDER BY lvl DESC LIMIT 1)
SELECT doc_id, leaf.digest AS leaf, sub.digest AS subroot, root.digest AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.digest AS folded_root, folded.digest = root.digest AS verified
FROM leaf JOIN sub ON leaf.tree = sub.lang CROSS JOIN root LEFT JOIN proof ON proof.r = leaf.r JOIN folded ON folded.r = leaf.r AND folded.step = coalesce(proof.height, 0)
"""
