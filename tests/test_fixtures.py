"""Small hand-made inputs with known answers."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, orderstats, text, time, vector
from tessera.operators import clusters, entities, events, metrics, retrieval, sequences, structured, text_index
from tessera.plans.spec import HARD, SEMANTIC, Constraint, QuerySpec, spec_from_filters, strategy


@pytest.fixture(scope="module")
def album(spark):
    rows = [
        ("a1", "2024-01-15 10:00:00", "image", "home", "上海", None),
        ("a2", "2024-03-20 09:00:00", "image", "home", "杭州", None),
        ("a3", "2024-10-05 08:00:00", "image", "home", "上海", None),
        ("a4", "2024-10-20 11:00:00", "video", "home", "", None),
        ("a5", "2023-12-01 10:00:00", "image", "home", "贵阳", None),
    ]
    df = spark.createDataFrame(rows, "asset_id string, t string, media_type string, scope_id string, place string, city string")
    return df.withColumn("ts", F.to_timestamp("t")).drop("t")


def one(df):
    return df.first()[0]


def test_structured_facts(album):
    year = dict(scope_id="home", start=datetime(2024, 1, 1), end=datetime(2025, 1, 1))
    count = lambda **kw: one(structured.execute(album, QuerySpec(**(year | kw))))
    assert count(media=("image",)) == 3
    assert count() == 4
    assert count(media=("video",)) == 1
    assert count(not_media=("video",)) == 3
    assert count(scope_id="other") == 0
    assert count(place="上海") == 2
    assert one(structured.execute(album, QuerySpec(operation="first", **year))) == datetime(2024, 1, 15, 10)
    assert one(structured.execute(album, QuerySpec(operation="last", **year))) == datetime(2024, 10, 20, 11)
    months = {r.g: r.n for r in structured.execute(album, QuerySpec(operation="group_count", group_by="month", **year)).collect()}
    assert months == {"2024-01": 1, "2024-03": 1, "2024-10": 2}
    places = {r.g: r.n for r in structured.execute(album, QuerySpec(operation="group_count", group_by="place")).collect()}
    assert places == {"上海": 2, "杭州": 1, "贵阳": 1, "unknown": 1}
    assert structured.execute(album, QuerySpec(operation="exists", scope_id="none")).first().found is False


def test_entities_are_any_of(spark, album):
    mentions = spark.createDataFrame([("a3", "entity-1"), ("a3", "entity-1")], "asset_id string, entity_id string")
    found = structured.execute(album, QuerySpec(entity_ids=("entity-1",), operation="date_range"), mentions).first()
    assert (found.n, found.first_ts) == (1, datetime(2024, 10, 5, 8))


def test_a_date_as_end_takes_in_its_day():
    spec = spec_from_filters({"start": "2024-01-01", "end": "2024-01-31"}, datetime(2024, 6, 1))
    assert spec.end == datetime(2024, 2, 1)
    with pytest.raises(ValueError):
        spec_from_filters({"sql": "x"}, datetime(2024, 6, 1))
    assert strategy(QuerySpec(constraints=(Constraint("object", "dog"),))) == "hybrid"


@pytest.mark.parametrize(
    "said, meant",
    [("去年", "2025年"), ("上个月", "2026年7月"), ("去年十月", "2025年10月"), ("去年春天", "2025年3月-2025年5月"), ("去年冬天", "2025年12月-2026年2月"), ("最近一年", "2025年8月-2026年8月")],
)
def test_relative_times(said, meant):
    assert time.resolve_relative(said, datetime(2026, 8, 10)) == meant


def test_time_ranges():
    assert time.parse_range("2025年-2026年") == (datetime(2025, 1, 1), datetime(2027, 1, 1))
    assert time.parse_range("2025年3月-5月") == (datetime(2025, 3, 1), datetime(2025, 6, 1))
    assert time.parse_range("2023-10-05") == (datetime(2023, 10, 5), datetime(2023, 10, 6))
    assert time.parse_range("2023年12月") == (datetime(2023, 12, 1), datetime(2024, 1, 1))
    assert time.parse_range("someday") is None


def test_iso_times(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T08:00:00+08:00",), ("2024-01-01",), ("2024",), ("bad",), (None,)], "t string")
    found = [r[0] for r in rows.select(time.parse_iso(F.col("t"))).collect()]
    assert found == [datetime(2024, 1, 1)] * 3 + [None] * 3


def test_search_tokens(spark):
    rows = spark.createDataFrame([("浅黄色毛绒睡衣",), ("色",), (None,)], "t string")
    tokens = [r[0] for r in rows.select(text.search_tokens(F.col("t"))).collect()]
    assert {"浅黄色毛绒睡衣", "浅黄", "毛绒", "睡衣"} <= set(tokens[0]) and "色" not in tokens[0]
    assert tokens[1] == [] and tokens[2] == []


def test_lexical_search(spark):
    rows = spark.createDataFrame([("asset_1", "卧室睡衣自拍", "毛绒睡衣"), ("asset_2", "厨房做饭", "")], "asset_id string, caption string, clothing string")
    index = text_index.term_projection(rows, "asset_id", {"caption": "caption", "clothing": "clothing"})
    hits = text_index.lexical_hits(index, "asset_id", text_index.surfaces(spark, [(1, 0, "睡衣"), (2, 0, "色"), (3, 0, "卧室睡衣自拍")]), 10).collect()
    by = {(r.query_id, r.asset_id): r.raw_score for r in hits}
    assert (1, "asset_1") in by and not any(q == 2 for q, _ in by)
    asked = text_index.surfaces(spark, [(1, 0, "睡衣"), (3, 0, "卧室睡衣自拍")])
    held = lambda df: sorted(map(tuple, df.join(asked.select(F.explode(text.search_tokens(F.col("text"))).alias("token")).distinct(), "token", "left_semi").collect()))
    assert held(text_index.query_projection(rows, "asset_id", {"caption": "caption", "clothing": "clothing"}, asked)) == held(index)
    assert max((s, k) for k, s in by.items() if k[0] == 3)[0] >= 2


def test_hard_values(spark):
    row = spark.createDataFrame([("价格 ¥12.5，电话 13800138000，创于 1998 年，8元",)], "t string").select(text.hard_values(F.col("t")).alias("v")).first()
    assert [(x.kind, x.value) for x in row.v] == [("price", "12.5"), ("price", "8"), ("year", "1998"), ("phone", "13800138000")]


def test_geo(spark):
    row = spark.range(1).select(
        geo.parse_latlon(F.lit("30.2741, 120.1551")).alias("a"), geo.parse_latlon(F.lit("0,0")).alias("b"), geo.parse_latlon(F.lit("x")).alias("c"), geo.parse_latlon(F.lit("91,0")).alias("d"),
        geo.haversine(F.lit(30.2741), F.lit(120.1551), F.lit(31.2304), F.lit(121.4737)).alias("km"), geo.from_dms(F.lit(30.0), F.lit(30.0), F.lit(0.0), F.lit("S")).alias("dms"),
    ).first()
    assert row.a.lat == 30.2741 and row.b is None and row.c is None and row.d is None
    assert 150 < row.km < 180 and row.dms == -30.5


def test_vectors(spark):
    row = spark.range(1).select(vector.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0))).alias("odd"), vector.l2_normalised(F.array(F.lit(0.0))).alias("zero"), vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("same"), vector.set_overlap(F.array(F.lit("abc")), F.array(F.lit("ab"))).alias("held")).first()
    assert (row.odd, row.zero, row.same, row.held) == (0.0, [], 1.0, 0.7)


def test_rank_fusion(spark):
    hits = spark.createDataFrame([(1, "visual", "gt_visual", 0.90, 1), (1, "visual", "other", 0.85, 2), (1, "lexical", "gt_lexical", 3.0, 1), (1, "text", "gt_text", 0.60, 1)], "query_id int, channel string, asset_id string, raw_score double, rank int")
    order = lambda df: [r.asset_id for r in df.orderBy("position").collect()]
    assert order(retrieval.rank_visual_only(hits)) == ["gt_visual", "other"]
    assert order(retrieval.rank_backbone(hits)) == ["gt_visual", "other", "gt_lexical", "gt_text"]
    assert order(retrieval.rank_late_fusion(hits))[0] == "gt_visual"
    fused = {r.asset_id: r.score for r in retrieval.fuse(hits).collect()}
    assert fused["gt_lexical"] == pytest.approx(1 / 61)
    anchored = retrieval.fuse(hits, anchors=spark.createDataFrame([(1, "other")], "query_id int, asset_id string"))
    assert order(anchored)[0] == "other"


def test_adjacency_excludes_seeds_and_finds_siblings(spark):
    rows = spark.createDataFrame([("asset_1", "2024-01-01 14:00:00", "s", "e"), ("asset_2", "2024-01-01 14:05:00", "s", "x"), ("asset_3", "2024-01-09 15:00:00", "s", "e"), ("asset_4", "2024-01-01 14:02:00", "other", "y")], "asset_id string, t string, scope_id string, event_id string").withColumn("ts", F.to_timestamp("t"))
    seeds = rows.filter("asset_id = 'asset_1'")
    assert {r[0] for r in retrieval.time_neighbours(rows, seeds).collect()} == {"asset_2"}
    assert {r[0] for r in retrieval.siblings(rows, seeds, "event_id", 4, [F.asc("asset_id")]).collect()} == {"asset_3"}
    assert retrieval.time_neighbours(rows, rows.limit(0)).count() == 0


def test_evidence_levels(spark):
    rows = spark.createDataFrame([(1, "image", "shanghai", ["li"], "red dress"), (2, "image", None, [], "li in red"), (3, "video", "shanghai", [], "")], "id int, media_type string, place string, people array<string>, text string")
    asked = (Constraint("media", "image", HARD), Constraint("place", "shanghai", SEMANTIC), Constraint("person", "li", SEMANTIC))
    found = {r.id: r for r in retrieval.evaluated(rows, asked).collect()}
    assert (found[1].level, found[1].excluded, found[1].score) == ("exact", False, 1.0)
    assert (found[2].level, found[2].excluded) == ("approximate", False)
    assert found[3].excluded
    negated = {r.id: r for r in retrieval.evaluated(rows, (Constraint("media", "video", HARD, negated=True),)).collect()}
    assert (negated[1].excluded, negated[1].level, negated[3].excluded) == (False, "exact", True)


def test_trips(spark):
    rows = spark.createDataFrame([("e1", "2024-05-01 10:00:00", "hangzhou", 30.2741, 120.1551), ("e2", "2024-05-02 10:00:00", "shanghai", 31.2304, 121.4737), ("e3", "2024-05-09 10:00:00", "home", None, None), ("e4", "2024-08-01 10:00:00", "home", None, None)], "event_id string, t string, place string, lat double, lon double")
    rows = rows.withColumn("ts", F.to_timestamp("t")).withColumn("scope", F.lit(1))
    found = events.trips(rows, "scope", "event_id", "ts", "place", "lat", "lon").collect()
    assert len(found) == 1 and found[0].events == 2 and found[0].confidence == pytest.approx(0.69)


def test_quality_clusters():
    v = lambda deg: [np.cos(np.radians(deg)), np.sin(np.radians(deg))]
    run = lambda degs, q, pose, model=None, **kw: len(set(clusters.quality_clusters(list(range(len(degs))), np.array([v(d) for d in degs]), q, pose, model or ["m"] * len(degs), **kw).values()))
    assert run([0, 24, -24], [0.98, 0.90, 0.88], ["frontal", "left", "right"], threshold=0.78) == 1
    assert run([0, 48, 24], [0.98, 0.98, 0.08], ["frontal", "frontal", "unknown"], threshold=0.78) == 3
    assert run([0, 0], [0.9, 0.9], ["frontal"] * 2, ["a", "b"]) == 2
    assert run([0, 60], [0.90, 0.88], ["frontal"] * 2) == 1


def test_pairwise_metrics(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "truth string, found int")
    r = metrics.pairwise(rows, "truth", "found").first()
    assert (r.precision, r.recall, r.f1) == (pytest.approx(1 / 3), pytest.approx(1 / 2), pytest.approx(2 / 5))


def test_event_assignment():
    obs = [("a", 0.0, "home", "meal", "cooking", ["pan"]), ("b", 600.0, "home", "meal", "cooking", ["pan"]), ("c", 700.0, "park", "walk", "walking", ["dog"]), ("d", 9e4, "home", "meal", "cooking", ["pan"])]
    found = [e for _, e, _ in events.assign({"obs_id": i, "t": t, "location": p, "kind": k, "activity": a, "objects": set(o)} for i, t, p, k, a, o in obs)]
    assert found == ["event_a", "event_a", "event_c", "event_d"]


def test_consolidation_takes_the_best_pair_first():
    o = lambda t, lat, word: {"t": t, "gps": (lat, 20.0), "vector": None, "activity": word, "kind": "", "objects": set(), "people": set()}
    into = events.consolidation({"a": [o(0, 10.0, "walk")], "b": [o(60, 10.002, "walk"), o(61, 10.002, "walk")], "c": [o(120, 10.0021, "walk")], "d": [o(90_000, 10.0, "walk")]})
    assert into == {"a": "b", "b": "b", "c": "b", "d": "d"}


def test_even_indices():
    assert orderstats.even_indices(10, 4) == [0, 3, 6, 9]


def test_spaced_peaks(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.5), (2, 0.5), (1, 3.0)], "k int, t double")
    assert sorted(tuple(r) for r in sequences.spaced(rows, ["k"], "t", 1.5).collect()) == [(1, 0.0), (1, 2.5), (2, 0.5)]


def test_hard_value_query_holds_prices(spark, tmp_path):
    from tessera.plans.queries_facts import hard_value_extraction

    spark.createDataFrame([(1, "only ¥8 in 1998")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in hard_value_extraction(spark, str(tmp_path)).collect()) == [(1, "price", "8", 1), (1, "year", "1998", 1)]


def test_merge_candidates_of_very_many_types(spark, tmp_path):
    from tessera.plans.queries_graph import merge_candidates

    rows = spark.range(3000).selectExpr("id AS p_partkey", "concat('t', id % 1500) AS p_type", "'b' AS p_brand")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert merge_candidates(spark, str(tmp_path)).count() == 1500


def test_metadata_channel_by_places(spark, monkeypatch):
    rng = np.random.default_rng(5)
    moments = [None, *(datetime(2024, 1, 1 + int(d), int(h)) for d, h in zip(rng.integers(0, 9, 30), rng.integers(0, 24, 30)))]
    pick = lambda values: values[int(rng.integers(0, len(values)))]
    kinds = ["image", "video", None]
    assets = [(i, pick(moments), pick(kinds), "x") for i in range(300)] + [(7, moments[1], "image", "x")] * 2
    queries = [(i, pick(moments), pick(moments), pick([*kinds, "audio"]), "y") for i in range(60)]
    a = spark.createDataFrame(assets, "asset_id long, ts timestamp, media_type string, extra string")
    q = spark.createDataFrame(queries, "query_id int, start timestamp, end timestamp, media string, extra string")
    found = {}
    for most in (0, 1000):
        monkeypatch.setattr(retrieval, "MAX_SCANNING_QUERIES", most)
        for k in (1, 4, 500):
            found[most, k] = sorted((r.query_id, r.rank, r.asset_id) for r in retrieval.metadata_hits(a, q, k).collect())
    want = []
    for i, start, end, media, _ in queries:
        rows = [(t is None, -(t.timestamp() if t else 0), n) for n, t, m, _ in assets if (media is None or m == media) and (t is None or ((start is None or t >= start) and (end is None or t < end)))]
        want += [(i, rank, n) for rank, (_, _, n) in enumerate(sorted(rows), 1)]
    for (most, k), rows in found.items():
        assert rows == sorted(r for r in want if r[1] <= k), (most, k)
    monkeypatch.setattr(retrieval, "MAX_SCANNING_QUERIES", 0)
    assert retrieval.metadata_hits(a.limit(0), q).count() == retrieval.metadata_hits(a, q.limit(0)).count() == 0


def test_classified_labels(spark):
    from tessera.operators import review

    rows = spark.createDataFrame(
        [(1, " Lake ", None, ["deep", "odd", "deep", " "], "by the lake"), (2, "strange", "PARK", None, "a pond"), (3, "strange", "near the lakeside", ["odd"], "pond"), (4, None, None, None, None), (5, "water", "park", [], "")],
        "i int, a string, b string, d array<string>, t string",
    )
    found = review.classified([F.col("a"), F.col("b")], F.col("d"), F.col("t"), ["LAKE", "PARK"], {"water": "LAKE"}, [("lake", "LAKE")], ["deep"], [("pond", "small")])
    got = {r.i: (r.f.primary, r.f.details, r.f.raw) for r in rows.select("i", found.alias("f")).collect()}
    assert got == {1: ("LAKE", ["deep"], ["odd"]), 2: ("PARK", ["small"], ["strange"]), 3: ("LAKE", [], ["strange", "odd"]), 4: ("OTHER", [], []), 5: ("LAKE", [], ["water"])}
