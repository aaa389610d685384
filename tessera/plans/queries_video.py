"""Video timelines over the event log (a user is a video, an event a frame) and the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import clusters, joins, sequences, timeline
from tessera.registry import query

#: Frames in SQL; frames() makes the same rows. Seconds are hours of the log, so that gaps are of a few units.
_FRAMES = """f AS (SELECT user_id AS video, event_id AS frame, epoch_us(ts) // 1000000 / 3600::DOUBLE AS t, value / 100 AS score, event_id % 7 / 7::DOUBLE AS gain, ['l' || event_id % 2, 'm' || event_id % 3] AS labels, event_id % 4 AS track, event_id % 10 / 10::DOUBLE AS x, event_id % 13 / 13::DOUBLE AS y FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    label = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    return catalog.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"), k.alias("frame"), (F.floor(joins.micros("ts") / 1_000_000) / 3600.0).alias("t"), (F.col("value") / 100).alias("score"), (k % 7 / 7.0).alias("gain"),
        F.array(label("l", 2), label("m", 3)).alias("labels"), (k % 4).alias("track"), (k % 10 / 10.0).alias("x"), (k % 13 / 13.0).alias("y"),
    )


_SCENES = f"""{_FRAMES}, b AS (SELECT *, sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS scene_no FROM f),
sc AS (SELECT video, scene_no, min(t) AS start_s, max(t) AS end_s, count(*) AS frames, list_sort(list_distinct(flatten(list(labels)))) AS labels FROM b GROUP BY ALL)"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.scenes(frames(spark, sf_dir).withColumn("boundary", F.col("score") > 0.5), "video", "t", "boundary", "labels", "frame")


@query("video_scenes", f"WITH {_SCENES} SELECT video, scene_no, round(start_s, 5) AS start_s, round(end_s, 5) AS end_s, frames, array_to_string(labels, ',') AS labels FROM sc")
def video_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes between boundaries, with their labels."""
    return _scenes(spark, sf_dir).select("video", "scene_no", F.round("start_s", 5).alias("start_s"), F.round("end_s", 5).alias("end_s"), "frames", F.array_join("labels", ",").alias("labels"))


@query(
    "merged_scenes",
    f"""WITH RECURSIVE {_SCENES}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_s) AS i FROM sc),
    fold AS (SELECT video, i, start_s, end_s, frames::BIGINT AS frames, labels, i AS head FROM n WHERE i = 1
      UNION ALL SELECT n.video, n.i, CASE WHEN j THEN fold.start_s ELSE n.start_s END, n.end_s, CASE WHEN j THEN fold.frames + n.frames ELSE n.frames END, CASE WHEN j THEN list_sort(list_distinct(list_concat(fold.labels, n.labels))) ELSE n.labels END, CASE WHEN j THEN fold.head ELSE n.i END
      FROM (SELECT f2.*, n2.i AS next, n2.end_s - n2.start_s < 3 AND len(list_intersect(f2.labels, n2.labels)) / len(list_distinct(list_concat(f2.labels, n2.labels))) >= 0.6 AS j FROM fold f2 JOIN n n2 ON n2.video = f2.video AND n2.i = f2.i + 1) fold JOIN n ON n.video = fold.video AND n.i = fold.next)
    SELECT video, round(start_s, 5) AS start_s, round(end_s, 5) AS end_s, frames, array_to_string(labels, ',') AS labels FROM (SELECT *, row_number() OVER (PARTITION BY video, head ORDER BY i DESC) AS r FROM fold) WHERE r = 1""",
)
def merged_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short scenes joined to alike ones before them."""
    found = timeline.merge_short(_scenes(spark, sf_dir), "video", key="scene_no")
    return found.select("video", F.round("start_s", 5).alias("start_s"), F.round("end_s", 5).alias("end_s"), "frames", F.array_join("labels", ",").alias("labels"))


@query(
    "label_runs",
    f"""WITH {_FRAMES}, n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video, track ORDER BY t) > 20 THEN 1 ELSE 0 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY video, track ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n)
    SELECT video, track, run, round(min(t), 5) AS start_s, round(max(t), 5) AS end_s, count(*) AS n, least(5, count(*)) AS members FROM g GROUP BY video, track, run HAVING count(*) >= 2""",
)
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a track's observations without a gap, and how many evenly sampled members each has."""
    found = timeline.label_sessions(frames(spark, sf_dir), ["video", "track"], "t", 20.0)
    return found.select("video", "track", "run", F.round("start_s", 5).alias("start_s"), F.round("end_s", 5).alias("end_s"), "n", F.size("members").cast("long").alias("members"))


@query(
    "track_displacement",
    f"""WITH {_FRAMES}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM f WINDOW w AS (PARTITION BY video, track ORDER BY t)),
    g AS (SELECT video, track, coalesce(sum(d), 0) AS path, sqrt(pow(arg_max(x, t) - arg_min(x, t), 2) + pow(arg_max(y, t) - arg_min(y, t), 2)) AS net FROM s GROUP BY ALL) SELECT video, track, round(path, 6) AS path, round(net, 6) AS net, round(path, 9) >= 0.14 AND round(net, 9) >= 0.035 AS moving FROM g""",
)
def track_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each track goes, and whether it moves."""
    found = sequences.displacement(frames(spark, sf_dir), ["video", "track"], "t", "x", "y", key="frame")
    return found.select("video", "track", F.round("path", 6).alias("path"), F.round("net", 6).alias("net"), "moving")


@query(
    "keyframe_budget",
    f"""WITH {_SCENES}, r AS (SELECT *, row_number() OVER (PARTITION BY video, scene_no ORDER BY score DESC, t) = 1 AS best FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY video, best ORDER BY t) AS i, count(*) OVER (PARTITION BY video, best) AS whole, greatest(0, 40 - sum(best::INT) OVER (PARTITION BY video)) AS room FROM r)
    SELECT video, frame FROM n WHERE CASE WHEN best THEN i <= 40 ELSE room > 0 AND (i - 1) % greatest(1, ceil(whole / greatest(room, 1)))::BIGINT = 0 END""",
)
def keyframe_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most forty frames of each video: the best of each scene, then an even stride."""
    from pyspark.sql import Window as W

    number = F.sum((F.col("score") > 0.5).cast("int")).over(W.partitionBy("video").orderBy("t", "frame").rowsBetween(W.unboundedPreceding, 0))
    return timeline.keyframe_budget(frames(spark, sf_dir).withColumn("scene_no", number), "video", "scene_no", "score", "t", 40, "frame").select("video", "frame")


#: The five signals of a frame, with what they are made of here.
_SIGNALS = {"scene_score": "score", "information_gain": "gain", "sharpness": "frame % 11 / 11", "diversity": "frame % 17 / 17", "representativeness": "frame % 19 / 19"}
_UNIT = "CASE WHEN b{n} > a{n} THEN least(1, greatest(0, ({c} - a{n}) / (b{n} - a{n}))) WHEN y{n} > x{n} THEN least(1, greatest(0, ({c} - x{n}) / (y{n} - x{n}))) ELSE 0 END"


@query(
    "summary_scores",
    f"""WITH {_FRAMES}, g AS (SELECT video, frame, {", ".join(f"({c})::DOUBLE AS {n}" for n, c in _SIGNALS.items())} FROM f),
    q AS (SELECT video, {", ".join(f"quantile_cont({n}, 0.05) AS a{i}, quantile_cont({n}, 0.95) AS b{i}, min({n}) AS x{i}, max({n}) AS y{i}" for i, n in enumerate(_SIGNALS))} FROM g GROUP BY video)
    SELECT frame, round({" + ".join(f"{timeline.SUMMARY[n]} * {_UNIT.format(n=i, c=n)}" for i, n in enumerate(_SIGNALS))}, 9) AS summary FROM g JOIN q USING (video)""",
)
def summary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted sum of the summary's five signals, each robustly between 0 and 1 within its video."""
    rows = frames(spark, sf_dir).select("video", "frame", *[F.expr(c).cast("double").alias(n) for n, c in _SIGNALS.items()])
    return timeline.weighted(rows, "video", timeline.SUMMARY, "summary").select("frame", F.round("summary", 9).alias("summary"))


@query(
    "frame_deltas",
    """WITH f AS (SELECT label, vec_id, embedding AS p, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS h FROM embeddings), n AS (SELECT *, lag(p) OVER w AS q, lag(h) OVER w AS g FROM f WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT vec_id, round(coalesce(list_sum([abs(p[i]::DOUBLE - q[i]::DOUBLE) for i in range(1, len(p) + 1)]) / len(p) / 255, 0), 9) AS pixel_change,
      round(coalesce(sqrt(greatest(0, 1 - list_sum([sqrt(h[i] * g[i]) for i in range(1, len(h) + 1)]) / sqrt(list_sum(h) * list_sum(g)))), 0), 7) AS histogram_change FROM n""",
)
def frame_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to the frame before, vectors standing for pictures and histograms."""
    rows = catalog.load(spark, sf_dir, "embeddings").withColumn("h", F.transform("embedding", lambda x: F.abs(x).cast("double")))
    return timeline.frame_deltas(rows, "label", "vec_id", "embedding", "h").select("vec_id", F.round("pixel_change", 9).alias("pixel_change"), F.round("histogram_change", 7).alias("histogram_change"))


@query("frame_surprises")
def frame_surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How badly the ten vectors of a label before it predict each vector; tests/test_models.py holds it against a plain model."""
    found = timeline.dmd_residuals(catalog.load(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding")
    return found.select("vec_id", F.round("dmd_residual", 6).alias("surprise"))


@query("camera_shifts")
def camera_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much each vector of a label, as a picture eight wide, is shifted against the one before; tests/test_models.py has a plain model."""
    found = timeline.camera_shifts(catalog.load(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 8)
    return found.select("vec_id", "shift_rows", "shift_columns", F.round("shift", 9).alias("shift"))


@query(
    "representativeness",
    """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT * FROM e WHERE vec_id % 10 = 0), n AS (SELECT e.label, e.vec_id, min(least(2, greatest(0, 1 - list_inner_product(e.v, c.v)))) AS d FROM e JOIN c ON e.label = c.label GROUP BY ALL)
    SELECT label, count(*) AS frames, round(avg(exp(-d)), 9) AS representativeness FROM n GROUP BY label""",
)
def representativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each label's every tenth vector stands for all of it."""
    rows = catalog.load(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return timeline.representativeness(rows, rows.filter("vec_id % 10 = 0"), ["label"], "vec_id", "embedding").withColumn("representativeness", F.round("representativeness", 9))


@query(
    "scene_hierarchy",
    f"""WITH {_SCENES}, e AS (SELECT video, frame AS event_no, CASE frame % 5 WHEN 0 THEN 'Action' WHEN 1 THEN 'Expression' ELSE 'Object' END AS kind, t AS c, t + frame % 6 AS d FROM f),
    us AS (SELECT video, scene_no, (start_s * 1000000)::DECIMAL(30,3)::DOUBLE AS a0, trunc(start_s * 1000000) AS a, trunc(end_s * 1000000) AS b FROM sc), eu AS (SELECT video, event_no, kind, trunc(c * 1000000) AS c, trunc(d * 1000000) AS d FROM e),
    i AS (SELECT us.video, scene_no, event_no, kind, c, d FROM us JOIN eu ON us.video = eu.video AND d >= a AND c <= b),
    an AS (SELECT video, scene_no, event_no AS anchor, c AS x, d AS y FROM i WHERE kind = 'Action' UNION ALL SELECT video, scene_no, NULL, a, b FROM us WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.video = us.video AND i.scene_no = us.scene_no AND kind = 'Action')),
    m AS (SELECT an.video, an.scene_no, anchor, i.event_no, i.kind FROM an JOIN i ON an.video = i.video AND an.scene_no = i.scene_no AND i.d >= x AND i.c <= y AND (anchor IS NULL OR anchor <> i.event_no))
    SELECT an.video, an.scene_no, an.anchor, coalesce(string_agg(event_no::VARCHAR, ',' ORDER BY event_no) FILTER (kind = 'Action'), '') AS actions, coalesce(string_agg(event_no::VARCHAR, ',' ORDER BY event_no) FILTER (kind = 'Object'), '') AS objects, coalesce(string_agg(event_no::VARCHAR, ',' ORDER BY event_no) FILTER (kind = 'Expression'), '') AS expressions
    FROM an LEFT JOIN m ON m.video = an.video AND m.scene_no = an.scene_no AND m.anchor IS NOT DISTINCT FROM an.anchor GROUP BY an.video, an.scene_no, an.anchor""",
)
def scene_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes, their anchors, and what overlaps each."""
    rows = frames(spark, sf_dir)
    kind = F.when(F.col("frame") % 5 == 0, "Action").when(F.col("frame") % 5 == 1, "Expression").otherwise("Object")
    events = rows.select("video", F.col("frame").alias("event_no"), kind.alias("kind"), F.col("t").alias("start_s"), (F.col("t") + F.col("frame") % 6).alias("end_s"))
    found = timeline.scene_hierarchy(_scenes(spark, sf_dir), events, "video")
    return found.select("video", "scene_no", "anchor", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("actions", "objects", "expressions")])


@query("even_samples", f"WITH {_FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM f) SELECT video, frame FROM n WHERE n <= 6 OR i IN (SELECT round_even(k * (n - 1) / 5, 0)::BIGINT FROM range(0, 6) AS r(k))")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six frames of each video, evenly spread."""
    return timeline.even_sample(frames(spark, sf_dir), ["video"], ["t", "frame"], 6).select("video", "frame")


@query("greedy_boundaries")
def greedy_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene boundaries by falling score; tests/test_models.py holds them against a plain model."""
    return timeline.greedy_boundaries(frames(spark, sf_dir), "video", "t", "score").select("video", "frame")


@query("summary_frames")
def summary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each video's summary; tests/test_models.py holds them against a plain model."""
    rows = frames(spark, sf_dir).withColumn("duration", F.lit(24.0 * 30))
    return timeline.summary_frames(rows, "video", "t", "score", "gain", "duration", min_gap=4.0).select("video", "frame")


@query("gated_keyframes")
def gated_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate makes of every frame; tests/test_models.py holds it against a plain model."""
    rows = frames(spark, sf_dir).withColumnRenamed("gain", "novelty").withColumn("sharpness", F.col("score") * 100).withColumn("change", F.col("frame") % 20)
    return timeline.gated_keyframes(rows, "video", "t", "sharpness", "novelty", "change", shortest=2.0, longest=24.0, gain=0.5).select("video", "frame", F.round("gain", 9).alias("gain"), "gate")


@query(
    "text_rows",
    """WITH RECURSIVE b AS (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS i FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, y, i, y AS first, 0 AS row_no FROM b WHERE i = 1 UNION ALL SELECT b.l_orderkey, b.l_linenumber, b.y, b.i, CASE WHEN b.y - r.first > 26 THEN b.y ELSE r.first END, CASE WHEN b.y - r.first > 26 THEN r.row_no + 1 ELSE r.row_no END FROM r JOIN b ON b.l_orderkey = r.l_orderkey AND b.i = r.i + 1)
    SELECT l_orderkey, l_linenumber, row_no FROM r""",
)
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes (lines of an order) put into rows by their height on the page."""
    boxes = catalog.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 3).alias("y"))
    return clusters.text_rows(boxes, ["l_orderkey"], "y", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "row_no")


@query("greedy_tracks")
def greedy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections (views) given to tracks (clicks) of a user's day by rising cost; tests/test_models.py has a plain model."""
    rows = frames(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 24))
    kinds = catalog.load(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), "event_type")
    rows = rows.join(kinds, "frame")
    a = rows.filter("event_type = 'view'").select("video", "day", F.col("frame").alias("detection"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = rows.filter("event_type = 'click'").select("video", "day", F.col("frame").alias("track"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    cost = F.round(F.abs(F.col("x1") - F.col("x2")) + F.abs(F.col("y1") - F.col("y2")), 9)
    pairs = a.join(b, ["video", "day"]).select("video", "day", "detection", "track", cost.alias("cost"))  # a user's day bounds the pairs
    return clusters.assign_greedily(pairs, ["video", "day"], "detection", "track", "cost", 0.5)
