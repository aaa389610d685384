"""Lifecycle transforms, timelines and metrics on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text, time
from tessera.operators import entities, joins, lifecycle, metrics, scans, sequences, timeline


def test_corrections_apply_once(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    revisions = spark.createDataFrame([("k", "old", 1), ("j", "old", 4)], "key string, value string, revision int")
    p = spark.createDataFrame([("k", "t1", 1, "new", "2024-01-03"), ("j", "t2", 3, "late", "2024-01-03"), ("j", "t3", 4, "expired", "2024-01-01")], "key string, token string, base_revision int, value string, e string").withColumn("expires_at", F.to_timestamp("e"))
    after = lifecycle.apply_corrections(revisions, p, ["key"], now)
    assert {(r.key, r.value, r.revision) for r in after.collect()} == {("k", "old", 1), ("j", "old", 4), ("k", "new", 2)}
    assert lifecycle.apply_corrections(after, p, ["key"], now).count() == 3
    assert {(r.key, r.value) for r in lifecycle.current(after, ["key"]).collect()} == {("k", "new"), ("j", "old")}


def test_cascade_orphans_and_gaps(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    left = lifecycle.cascade({"t": (t, "id")}, spark.createDataFrame([(1,)], "id int"), "id")["t"]
    assert [r.id for r in left.collect()] == [2]
    log = spark.createDataFrame([("g", "open", 1), ("g", "resolved", 2), ("h", "open", 1)], "gap string, status string, at int")
    assert [r.gap for r in lifecycle.open_gaps(log, "gap", "at").collect()] == ["h"]
    items = spark.createDataFrame([(1, "2024-01-01", "active"), (2, "2024-06-01", "active")], "id int, t string, status string").withColumn("used", F.to_timestamp("t"))
    found = {r.id: r.status for r in lifecycle.demoted(items, "used", F.lit("2024-06-15").cast("timestamp")).collect()}
    assert found == {1: "stale", 2: "active"}
    v = spark.createDataFrame([("s", "image", str(i), m, d, i) for i, (m, d) in enumerate([("m1", [1.0]), ("m1", [1.0]), ("m2", [1.0, 2.0]), ("m1", [1.0, 2.0])])], "space string, source_type string, source_id string, model_name string, vector array<float>, updated_at int")
    assert {r.source_id for r in lifecycle.majority_model(v).collect()} == {"0", "1"}
    assert lifecycle.upsert_vectors(v, v.withColumn("updated_at", F.lit(9))).filter("updated_at = 9").count() == 4


def test_entities(spark):
    made = entities.find_or_create(spark.createDataFrame([("s", "place", "x", 0.2), ("s", "place", "x", 0.7)], "scope string, kind string, name string, c double"), ["scope", "kind", "name"], "c").first()
    assert made.confidence == 0.7 and made.mentions == 2 and made.entity_id.startswith("entity_")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a int, b int")
    merged = entities.remapped(edges, spark.createDataFrame([(2, 1)], "source int, target int"), ["a", "b"])
    assert {tuple(r) for r in merged.collect()} == {(1, 3)}


def test_nearest_record_ties_go_to_the_earlier(spark):
    ts = lambda df: df.withColumn("ts", F.to_timestamp("t")).drop("t")
    left = ts(spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 12:00:00"), (3, "b", "2024-01-01 10:00:00")], "id int, k string, t string"))
    right = ts(spark.createDataFrame([(10, "a", "2024-01-01 09:00:00", 0.1), (11, "a", "2024-01-01 11:00:00", 0.2), (12, "a", "2024-01-01 11:00:00", 0.3)], "rid int, k string, t string, v double"))
    found = {r.id: r.nearest_id for r in joins.nearest(left, right, ["k"], "ts", "ts", "rid", "v").collect()}
    assert found == {1: 10, 2: 11, 3: None}


def test_timeline(spark):
    frames = spark.createDataFrame([("v", float(i), i in (0, 3), [l], 0.1 * i) for i, l in enumerate("aabcc")], "video string, t double, boundary boolean, labels array<string>, score double")
    found = {r.scene_no: (r.start_s, r.end_s, r.labels) for r in timeline.scenes(frames, "video", "t", "boundary", "labels").collect()}
    assert found == {1: (0.0, 2.0, ["a", "b"]), 2: (3.0, 4.0, ["c"])}
    rows = spark.createDataFrame([("v", 0.0, 10.0, 5, ["a", "b"]), ("v", 10.0, 11.0, 1, ["a", "b"]), ("v", 11.0, 12.0, 1, ["z"])], "video string, start_s double, end_s double, frames int, labels array<string>")
    assert sorted((r.start_s, r.end_s) for r in timeline.merge_short(rows, "video").collect()) == [(0.0, 11.0), (11.0, 12.0)]
    seen = spark.createDataFrame([("t", "dog", x) for x in (0.0, 1.0, 2.0, 9.0)], "track string, label string, t double")
    assert [(r.start_s, r.n) for r in timeline.label_sessions(seen, ["track", "label"], "t", 1.6).collect()] == [(0.0, 3)]
    unit = spark.createDataFrame([("v", [1.0, 0.0]), ("v", [0.0, 1.0]), ("v", [1.0, 0.0])], "video string, x array<double>")
    assert timeline.diversity(unit, ["video"], "x").first().diversity == pytest.approx(2 / 3)
    scenes = spark.createDataFrame([("v", i // 10, float(i), float(i % 10)) for i in range(40)], "video string, scene int, t double, score double")
    kept = timeline.keyframe_budget(scenes, "video", "scene", "score", "t", budget=10)
    assert kept.count() <= 10 and {r.t for r in kept.collect()} >= {9.0, 19.0, 29.0, 39.0}
    x = np.stack([np.cos(np.arange(10) * 0.3), np.sin(np.arange(10) * 0.3)])
    assert timeline.dmd_residual(x) < 1e-6 < timeline.dmd_residual(np.c_[x, [[5.0], [5.0]]])


def test_sequences(spark):
    track = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.1, 0.0), ("a", 2, 0.2, 0.0), ("b", 0, 0.0, 0.0)], "k string, t int, x double, y double")
    assert {r.k: r.moving for r in sequences.displacement(track, ["k"], "t", "x", "y").collect()} == {"a": True, "b": False}
    picks = spark.createDataFrame([("v", 0.0, 0.9), ("v", 0.3, 0.8), ("v", 1.0, 0.7)], "v string, t double, s double")
    assert sorted(r.t for r in sequences.by_score(picks, ["v"], "t", "s", 0.45, 5).collect()) == [0.0, 1.0]


def test_metrics(spark):
    votes = spark.createDataFrame([(4, 4), (5, 3), (1, 2)], "ours int, theirs int")
    r = metrics.win_rate(votes, "ours", "theirs").first()
    assert r.win_rate == pytest.approx(2 / 3) and not r.passed
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, asset_id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (2, "x"), (3, "y")], "query_id int, asset_id string")
    m = metrics.hit_metrics(ranked, truth, (1, 5)).first()
    assert (m.hit_at_1, m.hit_at_5, m.mrr_of_hits) == (0.0, pytest.approx(1 / 3), 0.5)
    split = metrics.held_out_split(spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, c int"), "id", "c", 6)
    assert split.filter("hidden").count() == 6 and split.filter("hidden").select("c").distinct().count() == 3


def test_scans_and_texts(spark):
    rows = spark.createDataFrame([(i,) for i in range(25)], "id int")
    page = scans.paged(rows, [F.asc("id")], 3, 10)
    assert [(r.id, r.ordinal) for r in page.orderBy("ordinal").collect()] == [(20 + i, 21 + i) for i in range(5)]
    with pytest.raises(ValueError):
        scans.table_count(spark, "/nowhere", "secrets")
    r = spark.range(1).select(
        text.strip_admin_suffix(F.lit("昌黎县")).alias("a"), text.mapped(F.lit(" x "), {"x": "y"}).alias("b"), text.first_category(F.lit("毛绒睡衣"), [("top", ["衬衫"]), ("night", ["睡衣"])], "other").alias("c"), text.leaks_internal_id(F.lit("see asset_0123456789ab")).alias("d"),
        time.normalise_exif(F.lit("2024:01:02 03:04:05"), F.lit("+08:00")).alias("e"), F.size(text.sentences(F.lit("一。二！three"))).alias("f"), text.contains(F.lit("ABC"), F.lit("")).alias("g"), F.date_format(time.add_seconds(F.lit("2024-01-01").cast("timestamp"), F.lit(1.5)), "ss.S").alias("h"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("昌黎", "y", "night", True, "2024-01-02T03:04:05+08:00", 3, False, "01.5")
