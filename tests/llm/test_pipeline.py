"""The pipeline's stages, each on what its predecessor kept."""

import hashlib
import os
import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
from tessera.llm import decontaminate, langid, mixing
from tessera.llm.common import table, written
from tests.llm.test_corpus import brute_fingerprint, brute_hits, brute_shards

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "shard":
            assert docs.columns == columns
    n = {k: v.count() for k, v in seen.items()}
    assert n["language_id"] == 200  # all of them are clean text
    assert 0 < n["decontaminate"] <= n["near_duplicates"] <= n["language_id"]
    assert seen["near_duplicates"].select("doc_id").distinct().count() == n["near_duplicates"]
    assert n["shard"] == n["mix_sources"] > 0
    assert set(docs.columns) == {*columns, "shard", "slot"}


def test_odd_and_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int"
    rows = [(1, "one two three", "en", "a", 13, "x", 1), (1, "one two three", "en", "a", 13, "x", 1), (None, "no id", None, None, None, None, None), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "y", 2), (None, None, None, None, None, None, None), (4, "w " * 5000, "en", "b", 10_000, "", 0)]
    for data, least in ((rows, 1), ([], 0), ([(1, "a b", None, None, None, None, None)], 1)):
        docs = spark.createDataFrame(data, schema)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
            assert sorted(docs.columns) == sorted({*columns, *(("shard", "slot") if name == "shard" else ())})
        assert docs.count() >= least


def test_run_gives_the_same_rows_again(spark):
    rows = lambda: sorted((r.doc_id, r.shard, r.slot, r.text) for r in corpus_pipeline.run(spark, SF).collect())
    assert rows() == rows()


def brute_mix(rows, seed=mixing.SEED):
    """Words taken of each (doc_id, text, source) row: every source's words on a circle, walked word by word."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(split(text))
    taken = Counter()
    for p in mixing.plan_mixture(dict(sizes)):
        own = [(int(hashlib.md5(f"{seed}:{'n' if i is None else i}:{len(split(t))}".encode()).hexdigest()[:15], 16), i, len(split(t))) for i, t, s in rows if s == p.source]
        circle = [i for _, i, n in sorted(own) for _ in range(n)]
        for d in range(p.quota * p.block):
            taken[circle[(p.offset + d) % len(circle)]] += 1
    return taken


def test_run_against_a_plain_version(spark):
    docs = {r.doc_id: (r.text, r.source, r.lang) for r in table(spark, SF, "documents").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    model = langid.train(table(spark, SF, "documents"), held_out=None)
    told = langid.predict([t for t, _, _ in docs.values()], model)
    kept = [i for i, p in zip(docs, told) if p[0] != "und" and p[2] >= langid.MIN_FAMILIAR]
    # One of each component of fingerprints at three differing bits or fewer.
    prints, top = {i: brute_fingerprint(docs[i][0]) for i in kept}, {i: i for i in kept}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for n, a in enumerate(kept):
        for b in kept[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    kept = [i for i in kept if root(i) == i]
    long = [(i, t) for i, t in items if len(re.findall(r"\w+", t or "")) >= decontaminate.MIN_REMOVED_WORDS]
    kept = [i for i in kept if not brute_hits(docs[i][0], long)[1]]
    taken = brute_mix([(i, docs[i][0], docs[i][1]) for i in kept])
    found = corpus_pipeline.run(spark, SF).collect()
    words = Counter()
    for r in found:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert (r.source, r.lang) == docs[r.doc_id][1:]
    assert words == Counter({i: n for i, n in taken.items() if n})
    # All but the documents at which a walk begins or ends keep their texts as they are.
    assert len({r.doc_id for r in found if r.text != docs[r.doc_id][0]}) <= 2 * len({s for _, s, _ in docs.values()})
    want = Counter((i, shard, slot) for i, _, _, shard, slot in brute_shards([(r.doc_id, r.text) for r in found]))
    assert Counter((r.doc_id, r.shard, r.slot) for r in found) == want


def test_texts_go_to_python_in_small_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates):
            spark.conf.set(conf, before)
            stage(spark, spark.createDataFrame([(1, "one two three", "en")], "doc_id long, text string, lang string"), "")
            assert int(spark.conf.get(conf)) <= 2000
    finally:
        spark.conf.set(conf, before)


def test_executors_need_one_set_of_python_workers(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    root, environment = str(Path(corpus_pipeline.__file__).parent), spark.sparkContext.environment
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates):
        monkeypatch.setitem(environment, "PYTHONPATH", "")  # the workers' path is part of what tells daemons apart
        stage(spark, docs, SF)
        assert root in environment["PYTHONPATH"].split(os.pathsep)

    def plain(*_):
        raise AssertionError("rows of the driver go through plain Python workers")

    monkeypatch.setattr(spark.sparkContext, "parallelize", plain)
    assert langid.train(docs).langs
    assert mixing.mixed_documents(docs).count() > 0
