"""Operator 11 against a plain tree, and edge cases. (Its SQL is compared in test_corpus.)"""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos int, tree string, tie long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def climb(nodes):
    """The root of a list of digests and, for each, its siblings as (left, right) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // 8 * 8
            paths[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + 8])))
            at[i] = a // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        lowered = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        cheat = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees.setdefault(r[2], []).append((r[0], leaf(r, r[1]), leaf(r, lowered) if cheat else leaf(r, r[1])))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {t: climb([x[1] for x in trees[t]]) for t in order}
    root, upper = climb([low[t][0] for t in order])
    out = []
    for t, above in zip(order, upper):
        for (i, own, start), path in zip(trees[t], low[t][1]):
            for left, right in path + above:
                start = sha(left + start + right)
            out.append((i, own, low[t][0], root, sha("".join(a + b for a, b in path + above)), start, start == root))
    return out


def rows_of(n):
    langs = ["en"] * 5 + ["", None, "zz", "é", "EN"]
    return [(i if i % 17 else None, f"Text {i % 5} ABC é" if i % 7 else None, langs[i % 10], "a" if i % 3 else None, i if i % 4 else None, "x", 1, "t", 5) for i in range(n)]


@pytest.mark.parametrize("n, levels", [(1, 4), (9, 4), (300, 1), (300, 2), (700, 4)])
def test_same_as_a_plain_tree(spark, n, levels):
    docs = spark.createDataFrame(rows_of(n), DOCS)
    found = merkle.manifest(merkle.with_tampering(docs), levels=levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows_of(n))))


def test_a_tree_without_tampering_verifies_whole(spark):
    found = merkle.manifest(spark.createDataFrame(rows_of(50), DOCS)).collect()
    assert all(r.verified and r.folded_root == r.root for r in found)


def test_repeated_long_and_empty_texts(spark):
    rows = [(3, "Same", "en", "a", 4, None, None, None, None)] * 70 + [(5, "", "en", "a", 0, None, None, None, None), (6, "Long " * 200_000, "de", "b", None, None, None, None, None), (None,) * 9, (None,) * 9]
    found = merkle.manifest(merkle.with_tampering(spark.createDataFrame(rows, DOCS).repartition(5)), levels=1).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


def test_no_documents(spark):
    assert merkle.manifest(merkle.with_tampering(spark.createDataFrame([], DOCS))).collect() == []


def test_a_language_of_all_rows_is_many_tasks(spark, monkeypatch):
    """Equal rows, too, are dealt out over the partitions."""
    tables = {}
    monkeypatch.setattr(merkle, "written", lambda df, what: tables.setdefault(what, written(df, what)))
    found = merkle.numbered(spark.range(4000).select(F.lit("len").alias("tree"), F.lit(1).alias("doc_id")), "doc_id")
    assert sorted(tuple(r) for r in found.select("pos", "n").collect()) == [(i, 4000) for i in range(4000)]
    sizes = [r["count"] for r in tables["ordered"].groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
