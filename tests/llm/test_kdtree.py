"""Operator 12 against brute force, and edge cases. (Its SQL is compared in test_corpus.)"""

import math

import numpy as np
import pytest

from tessera.llm import kdtree

ROWS = "vec_id long, embedding array<float>, label int, v int, shard string, query_id int"


def brute(rows, every=20, k=20):
    vectors = {(i, tuple(math.floor(64 * float(np.float32(c))) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q in sorted({i for i, _ in vectors if i % every == 0}):
        best = {}
        for i, v in vectors:
            for j, w in vectors:
                if i == q and j != q and len(v) == len(w):
                    best[j] = max(best.get(j, -(1 << 200)), sum(a * b for a, b in zip(v, w)))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n, j, max(min(s, 2**63 - 1), -(2**63))) for n, (j, s) in enumerate(top, 1)]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 1, 2, "x", 3) for i, v in rows], ROWS)
    out = kdtree.top_k(df, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0, 0, 0, 0]), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (64, [0.0] * 6), (65, []), (80, []), (66, [1.0, -2.0]), (100, [3.0, 1.0])]
    rows += [(20, [9.0, 0, 0, 0, 0, 0]), (7, [9.0, 1, 0, 0, 0, 0]), (7, [9.0, 1, 0, 0, 0, 0]), (120, [-0.001] * 6), (-20, [0.5] * 6)]
    assert found(spark, rows) == brute(rows)


def test_many_copies_and_ties(spark, monkeypatch):
    """A third of all rows equal, over more than one shard; whole numbers tie often."""
    monkeypatch.setattr(kdtree, "LEAST_SHARD", 32)
    monkeypatch.setattr(kdtree, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [0.25, 0.5, -0.25]) for i in range(0, 300, 3)] + [(i, (rng.integers(-4, 5, 3) / 32).tolist()) for i in range(300) if i % 3]
    assert found(spark, rows, k=5) == brute(rows, k=5)


def test_an_id_with_several_vectors_counts_once(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "LEAST_SHARD", 32)
    rng = np.random.default_rng(3)
    rows = [(i % 40, rng.normal(size=4).tolist()) for i in range(200)]
    assert found(spark, rows, k=3) == brute(rows, k=3)


def test_numbers_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i), 3e30 if i % 7 == 0 else -1.0, 0.5]) for i in range(30)]
    assert found(spark, rows, k=4) == brute(rows, k=4)


def test_fewer_candidates_than_k(spark):
    assert found(spark, [(0, [1.0, 2.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])]) == brute([(0, [1.0, 2.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])])
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []


@pytest.mark.parametrize("dims", [2, 8])
def test_bounds_leave_out_what_cannot_matter(dims):
    """On clustered vectors a search opens few leaves, and finds what all of them hold."""
    rng = np.random.default_rng(dims)
    centres = rng.integers(-60, 61, (40, dims))
    x = (np.repeat(centres, 200, axis=0) + rng.integers(-2, 3, (8000, dims))).astype(float)
    ids, q = rng.permutation(8000), x[::160]
    tree, seen = kdtree.Tree(x, leaf=64), []
    add = kdtree.Nearest.add
    kdtree.Nearest.add = lambda self, at, scores, i: (seen.append(scores.size), add(self, at, scores, i))[1]
    try:
        best = kdtree.walk(tree, x, ids, q, ids[::160], np.full(len(q), -np.inf), 10)
    finally:
        kdtree.Nearest.add = add
    assert sum(seen) < 0.2 * len(q) * len(x)
    for i, own in enumerate(ids[::160]):
        s = x @ q[i]
        s[ids == own] = -np.inf
        want = np.lexsort((ids, -s))[:10]
        assert best.ids[i].tolist() == ids[want].tolist() and best.scores[i].tolist() == s[want].tolist()


def test_boxes_are_tight_and_leaves_hold_all():
    x = np.random.default_rng(4).integers(-9, 10, (1000, 3)).astype(float)
    tree = kdtree.Tree(x, leaf=16)
    leaves = [s for s, k in zip(tree.spans, tree.kids) if k < 0]
    assert sorted(tree.order.tolist()) == list(range(1000)) and sum(b - a for a, b in leaves) == 1000
    for (a, b), low, high in zip(tree.spans, tree.low, tree.high):
        part = x[tree.order[a:b]]
        assert (part.min(axis=0) == low).all() and (part.max(axis=0) == high).all()
