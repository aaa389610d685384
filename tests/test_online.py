"""Online assignment against a plain model, in batches and streams; stored prototypes carry over."""

import numpy as np
import pytest

from tessera.operators import online

SAMPLE = "id long, scope_id string, model string, view string, quality double, eligible boolean, vector array<double>, at int"
KNOWN = "scope_id string, model string, cluster_id string, view string, quality double, vector array<double>"


def plain(samples, known=(), threshold=0.30, minimum=0.30, limit=6):
    """One sample after the other, every cluster's prototypes as a dict."""
    clusters, out = {}, {}
    for scope, model, name, view, quality, x in sorted(known, key=lambda r: (r[2], r[3])):
        clusters.setdefault((scope, model), {}).setdefault(name, {})[view] = (quality, np.array(x))
    for i, scope, model, view, quality, eligible, x, _ in sorted(samples, key=lambda s: (s[7], s[0])):
        if not eligible or not x:
            out[i] = (None, 0.0)
            continue
        mine, best, score = clusters.setdefault((scope, model), {}), None, 0.0
        if quality >= minimum:
            for name, views in mine.items():
                s = max(float(np.array(x) @ v) for _, v in views.values())
                if s > score:
                    best, score = name, s
        if best is None or score < threshold:
            best = f"new_{i}"
            mine[best] = {}
        out[i] = (best, score)
        views = mine[best]
        if view in views and views[view][0] >= quality:
            continue
        if view not in views and len(views) >= limit:
            worst = min(views, key=lambda v: (views[v][0], v))
            if views[worst][0] >= quality:
                continue
            del views[worst]
        views[view] = (quality, np.array(x))
    return out


def made(n, seed, dims=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, f"s{i % 2}", f"m{i % 3 // 2}", "abcdefghi"[int(rng.integers(0, 9))], float(rng.integers(0, 10)) / 10, i % 13 != 0, x[i].tolist(), i // 40) for i in range(n)]


def found(df):
    return {r.id: (r.cluster_id, r.score) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][0] == b[i][0] and a[i][1] == pytest.approx(b[i][1], abs=1e-12)


def test_alike_samples_of_a_batch_share_a_cluster(spark):
    rows = [(1, "s", "m", "front", 0.9, True, [1.0, 0.0, 0.0], 1), (2, "s", "m", "front", 0.8, True, [0.99, 0.01, 0.0], 2), (3, "s", "m", "front", 0.9, True, [0.0, 1.0, 0.0], 3), (4, "other", "m", "front", 0.9, True, [1.0, 0.0, 0.0], 4), (5, "s", "m2", "front", 0.9, True, [1.0, 0.0, 0.0], 5)]
    got = found(online.assign_online(spark.createDataFrame(rows, SAMPLE), None, "id", "at"))
    assert {i: c for i, (c, _) in got.items()} == {1: "new_1", 2: "new_1", 3: "new_3", 4: "new_4", 5: "new_5"}


@pytest.mark.parametrize("options", [{}, {"limit": 2, "threshold": 0.6}])
def test_same_as_the_plain_model(spark, options):
    rows = [*made(900, 1), (5000, "s0", "m0", None, 0.9, True, None, 3), (5001, None, "m0", "a", 0.9, True, [1.0, 0, 0, 0], 3), (5002, None, "m0", "a", 0.9, True, [1.0, 0, 0, 0], 3)]
    known = [("s0", "m0", f"k{i}", v, 0.5, x) for i, (*_, v, _, _, x, _) in enumerate(r for r in made(20, 2))]
    df = spark.createDataFrame([(*r[:6], r[6] and [float(c) for c in r[6]], r[7]) for r in rows], SAMPLE).repartition(5)
    same(found(online.assign_online(df, spark.createDataFrame(known, KNOWN), "id", "at", **options)), plain([(*r[:3], r[3] or "unknown", *r[4:]) for r in rows], known, **options))


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    """Five micro-batches in order; state of prototypes from clusters that there were."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, known = made(200, 3), spark.createDataFrame([("s0", "m0", "k1", "a", 0.5, [1.0, 0.0, 0.0, 0.0])], KNOWN)
    for n in range(5):
        spark.createDataFrame([r for r in rows if r[7] == n], SAMPLE).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(SAMPLE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = online.assigned_stream(source, known, "id", "at")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    same(found(spark.read.parquet(f"{tmp_path}/out")), found(online.assign_online(spark.createDataFrame(rows, SAMPLE), known, "id", "at")))


def test_nearest_clusters_in_blocks(spark, monkeypatch):
    rows, known = made(120, 4), [("s0", "m0", f"k{i % 7}", "a", 0.5, r[6]) for i, r in enumerate(made(30, 5))]
    monkeypatch.setattr("tessera.operators.retrieval.BLOCK_VECTORS", 5)
    monkeypatch.setattr("tessera.operators.retrieval.BLOCK_QUERIES", 11)
    got = found(online.nearest_clusters(spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(known, KNOWN), "id"))
    for i, scope, model, _, quality, eligible, x, _ in rows:
        scores = {}
        for s, m, c, _, _, v in known:
            if (s, m) == (scope, model) and eligible and quality >= 0.3:
                scores[c] = max(scores.get(c, -1.0), float(np.array(v) @ np.array(x)))
        best = min(scores, key=lambda c: (-round(scores[c], 9), c), default=None)
        want = (best, scores[best]) if best and scores[best] >= 0.3 else (None, 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-8)


def test_the_query(spark):
    """Every row of the query, by the plain model over the same rows."""
    from tessera import registry
    from tessera.plans import queries_lifecycle

    registry.load()
    samples, known = queries_lifecycle._arrivals(spark, "/root/testdata/sf0.001")
    rows = [(r.vec_id, r.scope_id, r.model, r.view, r.quality, r.eligible, list(r.vector), r.vec_id) for r in samples.collect()]
    seeds = [(r.scope_id, r.model, str(r.cluster_id), r.view, r.quality, list(r.vector)) for r in known.collect()]
    # Of several prototypes of a cluster and view the best stays, the first of equal ones.
    got = {r.vec_id: (r.cluster_id, r.score) for r in registry.QUERIES["online_clusters"](spark, "/root/testdata/sf0.001").collect()}
    best = {}
    for r in seeds:
        if best.get((r[0], r[1], r[2], r[3]), (-1,))[0] < r[4]:
            best[r[0], r[1], r[2], r[3]] = (r[4], r[5])
    same(got, plain(rows, [(*k, *v) for k, v in best.items()], threshold=0.2))
