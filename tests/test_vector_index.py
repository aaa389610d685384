"""The stored vector index: order, scopes, additions, removals, replacement, compaction, recall, and what a lost writer leaves."""

import numpy as np
import pytest

from tessera.operators import retrieval, vector_index
from tessera.operators.vector_index import VectorIndex

SMALL = [("v1", "home", [1.0, 0.0, 0.0]), ("v2", "home", [0.9, 0.1, 0.0]), ("v3", "home", [0.0, 1.0, 0.0]), ("v4", "other", [0.0, 0.0, 1.0])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, scope_id string, vector array<double>")


def asked(spark, *queries):
    return spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(queries)], "query_id int, q array<double>, scope_id string")


def ids(index, q, k, scope=None):
    return [r.asset_id for r in sorted(index.search(asked(index.spark, (q, scope)), k).collect(), key=lambda r: r["rank"])]


@pytest.fixture()
def small(spark, tmp_path):
    return VectorIndex.build(frame(spark, SMALL), str(tmp_path / "index"), "m1")


def test_order_and_scope(small):
    assert ids(small, [1.0, 0.0, 0.0], 2) == ["v1", "v2"]
    assert ids(small, [0.0, 0.0, 1.0], 3, "home") == ["v1", "v2", "v3"]  # none of another scope, however near
    assert ids(small, [0.0, 0.0, 1.0], 3, "nowhere") == [] and ids(small, [1.0, 0.0], 3) == []


def test_additions_removals_and_replacement(spark, small):
    index = small.add(frame(spark, [("v5", "home", [1.0, 0.0, 0.1])]))
    assert ids(index, [1.0, 0.0, 0.0], 1) == ["v1"] and "v5" in ids(index, [1.0, 0.0, 0.0], 3)
    index = index.remove(spark.createDataFrame([("v1",), ("v2",), ("unknown",)], "asset_id string"))
    assert ids(index, [1.0, 0.0, 0.0], 1) == ["v5"] and index.manifest["source_count"] == 3
    index = index.add(frame(spark, [("v1", "home", [0.0, 0.0, -1.0]), ("v5", "home", [0.0, 1.0, 0.0])]))  # back again; replaced
    assert ids(index, [0.0, 0.0, -1.0], 1) == ["v1"] and index.manifest["source_count"] == 4
    assert sorted(r.asset_id for r in index.live().collect()) == ["v1", "v3", "v4", "v5"]
    assert ids(index.compacted(), [0.0, 0.0, -1.0], 1) == ["v1"]


def test_an_older_index_stays_readable(spark, small):
    small.remove(spark.createDataFrame([("v1",)], "asset_id string"))
    assert ids(small, [1.0, 0.0, 0.0], 1) == ["v1"]
    assert ids(VectorIndex.load(spark, small.path), [1.0, 0.0, 0.0], 1) == ["v2"]


def test_saved_elsewhere_and_loaded(spark, small, tmp_path):
    small.save(str(tmp_path / "copy"))
    again = VectorIndex.load(spark, str(tmp_path / "copy"))
    assert ids(again, [1.0, 0.0, 0.0], 2) == ["v1", "v2"] and again.manifest["id_map_checksum"] == small.manifest["id_map_checksum"]


def test_a_lost_writer_leaves_the_last_index(spark, small):
    """A segment that no manifest names is nothing."""
    small._next()._with_segment(frame(spark, [("v9", "home", [1.0, 0.0, 0.0])]).selectExpr("asset_id", "scope_id", "cast(vector as array<float>) as vector"))
    again = VectorIndex.load(spark, small.path)
    assert again.manifest == small.manifest and "v9" not in ids(again, [1.0, 0.0, 0.0], 4)


def test_other_models_are_refused(spark, small, tmp_path):
    assert small.incompatible("m1", 3) is None
    assert small.incompatible("m2", 3) == "model_mismatch:m1vsm2" and small.incompatible("m1", 4) == "dimension_mismatch:3vs4" and small.incompatible("m1", 3, "l2") == "space_mismatch:cosine"
    with pytest.raises(ValueError, match="model_mismatch"):
        small.search(asked(spark, ([1.0, 0.0, 0.0], None)), 1, model="m2")
    with pytest.raises(ValueError, match="no_manifest"):
        VectorIndex.load(spark, str(tmp_path / "none"))


def test_many_segments_become_one(spark, small, monkeypatch):
    monkeypatch.setattr(vector_index, "MAX_SEGMENTS", 2)
    index = small
    for i in range(3):
        index = index.add(frame(spark, [(f"n{i}", "home", [0.0, float(i), 1.0])]))
    assert len(index.manifest["segments"]) <= 2 and index.live().count() == 7


def test_empty_index(spark, tmp_path):
    index = VectorIndex.build(frame(spark, [("a", None, None), ("b", None, [])]), str(tmp_path / "e"), "m1")
    assert index.live().count() == 0 and index.search(asked(spark, ([1.0], None)), 3).collect() == []


@pytest.mark.parametrize("clusters, most_visited", [(60, 0.4), (0, 1.0)])
def test_recall(spark, tmp_path, clusters, most_visited):
    """0.9 of the ten nearest after additions and removals; where vectors cluster, in a part of the lists."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(3000, 24)) if not clusters else rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 3000)] + rng.normal(size=(3000, 24)) * 0.1
    rows = [(str(i), str(i % 5), v.tolist()) for i, v in enumerate(x)]
    index = VectorIndex.build(frame(spark, rows[:2000]), str(tmp_path / "r"), "m1").add(frame(spark, rows[2000:]))
    index = index.remove(frame(spark, rows[::10]).select("asset_id"))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 100)], "query_id int, q array<double>")
    hits = lambda df: {(r.query_id, r.asset_id) for r in df.collect()}
    unit = queries.select("query_id", vector_index.F.transform("q", lambda c: c).alias("q"))
    exact = hits(retrieval.vector_hits(index.live(), unit, 10))
    found = hits(retrieval.vector_hits(index, queries, 10, strategy="index"))
    assert len(found) == len(exact) == 300 and len(found & exact) >= 270
    assert index.manifest["probes"] <= max(1, most_visited * len(index._centroids()))
    scoped = index.search(queries.selectExpr("query_id", "q", "'1' AS scope_id"), 10).collect()
    assert len(scoped) == 300 and all(int(r.asset_id) % 5 == 1 for r in scoped)


def test_more_queries_than_a_broadcast_holds(spark, small, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    index = VectorIndex.build(frame(spark, [(str(i), "s", rng.normal(size=6).tolist()) for i in range(400)]), str(tmp_path / "b"), "m1")
    queries = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "query_id int, q array<double>")
    of = lambda df: sorted((r.query_id, r["rank"], r.asset_id, round(r.raw_score, 9)) for r in df.collect())
    narrow, exact = of(index.search(queries, 5)), of(retrieval.vector_hits(index.live(), queries, 5).drop("channel"))
    several = index.live().unionAll(index.live().selectExpr("asset_id", "scope_id", "transform(vector, x -> cast(-x as float)) as vector"))
    both = of(retrieval.vector_hits(several, queries, 5).drop("channel"))
    for module in (retrieval, vector_index):
        monkeypatch.setattr(module, "MAX_BROADCAST_QUERIES", 3)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 50)
    assert of(index.search(queries, 5)) == narrow
    assert of(retrieval.vector_hits(index.live(), queries, 5).drop("channel")) == exact
    assert of(retrieval.vector_hits(several, queries, 5).drop("channel")) == both
    assert retrieval.all_scores(index.live(), queries).count() == 40 * 400


def test_ann_recall_holds_every_hundredth_vector_against_all(spark):
    from tessera import registry

    registry.load()
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)

    def nearest(x, i):
        s = (x * x[i]).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        return set(ids[other[np.lexsort((ids[other], -s[other]))][:10]])

    asked = np.flatnonzero(ids % 100 == 0)
    recall = np.mean([len(nearest(x, i) & nearest(x[:, :16], i)) / 10 for i in asked])
    (row,) = registry.QUERIES["ann_recall"](spark, sf).collect()
    assert (row.queries, row.alive, row.reached) == (len(asked), len(ids), True) and row.recall == pytest.approx(recall, abs=1e-9)
