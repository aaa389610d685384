"""Sessions, ranges, peaks, percentiles and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions.orderstats import nearest_rank, order_statistics, rounded_index, truncated_index
from tessera.operators import joins, sequences
from tessera.registry import query
from tessera.streaming import sessions as streams

_TS = "yyyy-MM-dd HH:mm:ss"


def _text(*columns: str) -> dict:
    return {c: F.date_format(c, _TS) for c in columns}


def _sessions_sql(seconds: int, where: str = "") -> str:
    return f"""n AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {seconds}000000 THEN 1 ELSE 0 END AS new FROM events {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM n)"""


_SESSION_OUT = "SELECT user_id, session_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, count(*) AS n FROM g GROUP BY user_id, session_no"


@query("sessions_gap_3d", f"WITH {_sessions_sql(259200)} {_SESSION_OUT}")
def sessions_gap_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.session_summary(catalog.load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3 * 86400).withColumns(_text("start_ts", "end_ts"))


@query("sessions_gap_6h", f"WITH {_sessions_sql(21600)} {_SESSION_OUT}")
def sessions_gap_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.session_summary(catalog.load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600).withColumns(_text("start_ts", "end_ts"))


@query("best_row_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def best_row_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_per_group(catalog.load(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query("budget_per_group", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 4")
def budget_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of each group (the operator's budget)."""
    return sequences.budget_per_group(catalog.load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 4).select("source", "doc_id")


@query("cover_pick", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def cover_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.cover(catalog.load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value")


@query(
    "interval_overlap",
    f"""WITH a AS (WITH {_sessions_sql(21600, "WHERE event_type = 'view'")} SELECT user_id, session_no, min(ts) AS s, max(ts) AS e FROM g GROUP BY ALL),
    b AS (WITH {_sessions_sql(43200, "WHERE event_type = 'click'")} SELECT user_id, session_no, min(ts) AS s, max(ts) AS e FROM g GROUP BY ALL)
    SELECT a.user_id, a.session_no, b.session_no AS other_no FROM a JOIN b ON a.user_id = b.user_id AND a.e >= b.s AND a.s <= b.e""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of views and of clicks that overlap."""
    rows = catalog.load(spark, sf_dir, "events")
    a = sequences.session_summary(rows.filter("event_type = 'view'"), ["user_id"], "ts", "event_id", 6 * 3600).select("user_id", "session_no", "start_ts", "end_ts")
    b = sequences.session_summary(rows.filter("event_type = 'click'"), ["user_id"], "ts", "event_id", 12 * 3600).select("user_id", F.col("session_no").alias("other_no"), F.col("start_ts").alias("s2"), F.col("end_ts").alias("e2"))
    return joins.overlaps(a, b, ["user_id"], "start_ts", "end_ts", "s2", "e2", 86400).select("user_id", "session_no", "other_no")


@query(
    "within_time_range",
    "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000",
)
def within_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views within an hour of a purchase of the same user."""
    rows = catalog.load(spark, sf_dir, "events")
    a = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("t1"))
    b = rows.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("right_id"), F.col("ts").alias("t2"))
    return joins.within(a, b, ["user_id"], "t1", "t2", 3600).select("left_id", "right_id")


@query(
    "nearest_record",
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS pid, user_id, ts AS pts, value FROM events WHERE event_type = 'purchase'),
    j AS (SELECT c.event_id, pid, value, abs(epoch_us(ts) - epoch_us(pts)) AS d, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(ts) - epoch_us(pts)), pts, pid) AS r FROM c LEFT JOIN p ON c.user_id = p.user_id)
    SELECT event_id, pid AS nearest_id, value AS nearest_value, d AS distance_us FROM j WHERE r = 1""",
)
def nearest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the purchase of the same user that is nearest in time, before or after."""
    rows = catalog.load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    found = joins.nearest(rows.filter("event_type = 'click'").select("event_id", "user_id", "ts"), rows.filter("event_type = 'purchase'").withColumnRenamed("event_id", "pid"), ["user_id"], "ts", "ts", "pid", "value")
    return found.select("event_id", "nearest_id", "nearest_value", "distance_us")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", F.hour("ts").cast("double").alias("hour"))
    return sequences.boundary_scores(rows, ["user_id"], {"value": 0.6, "hour": 0.4})


_ROBUST = "CASE WHEN quantile_cont({x}, 0.95) OVER w > quantile_cont({x}, 0.05) OVER w THEN least(1, greatest(0, ({x} - quantile_cont({x}, 0.05) OVER w) / (quantile_cont({x}, 0.95) OVER w - quantile_cont({x}, 0.05) OVER w))) WHEN max({x}) OVER w > min({x}) OVER w THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0 END"
_FRAMES_SQL = f"f AS (SELECT user_id, event_id, ts, {_ROBUST.format(x='value')} * 0.6 + {_ROBUST.format(x='h')} * 0.4 AS score FROM (SELECT *, hour(ts)::DOUBLE AS h FROM events) WINDOW w AS (PARTITION BY user_id))"


@query("robust_boundary_score", f"WITH {_FRAMES_SQL} SELECT event_id, round(score, 6) AS score FROM f")
def robust_boundary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("event_id", F.round("score", 6).alias("score"))


@query(
    "boundary_peaks",
    f"""WITH {_FRAMES_SQL}, m AS (SELECT user_id, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.88) AS q FROM f GROUP BY user_id),
    d AS (SELECT f.user_id, quantile_cont(abs(score - med), 0.5) AS mad FROM f JOIN m USING (user_id) GROUP BY f.user_id),
    n AS (SELECT *, lag(score) OVER w AS b, lead(score) OVER w AS a FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id FROM n JOIN m USING (user_id) JOIN d USING (user_id) WHERE score >= greatest(q, med + 2.8 * mad) AND coalesce(b, -1e9) <= score AND coalesce(a, -1e9) <= score""",
)
def boundary_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of the boundary score above a robust limit."""
    return sequences.peaks(_frames(spark, sf_dir), ["user_id"], "ts", "event_id").select("event_id")


@query("boundary_peaks_spaced")
def boundary_peaks_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks at least a day apart, greedily in time; tested against a plain model."""
    found = sequences.peaks(_frames(spark, sf_dir), ["user_id"], "ts", "event_id").select("user_id", (joins.micros("ts") / 1e6).alias("t"), "event_id")
    return sequences.spaced(found, ["user_id"], "t", 86400.0)


@query(
    "nearest_rank_percentiles",
    """WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, max(CASE WHEN k = greatest(1, ceil(n * 0.5)) THEN value END) AS p50, max(CASE WHEN k = greatest(1, ceil(n * 0.95)) THEN value END) AS p95,
    max(CASE WHEN k = round_even((n - 1) * 0.5, 0) + 1 THEN value END) AS r50, max(CASE WHEN k = least(n, floor(n * 0.95) + 1) THEN value END) AS t95 FROM r GROUP BY event_type""",
)
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact order statistics by three conventions."""
    return order_statistics(catalog.load(spark, sf_dir, "events"), ["event_type"], "value", {"p50": (nearest_rank, 0.5), "p95": (nearest_rank, 0.95), "r50": (rounded_index, 0.5), "t95": (truncated_index, 0.95)})


@query(
    "tool_performance",
    """WITH r AS (SELECT event_type AS tool, value, user_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events)
    SELECT tool, count(*) AS calls, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 9) AS ok_rate, max(value) AS max_value, count(DISTINCT user_id) AS users, max(CASE WHEN k = greatest(1, ceil(n * 0.95)) THEN value END) AS p95 FROM r GROUP BY tool""",
)
def tool_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, share of fast ones, maximum, users and 95th percentile of each tool."""
    rows = catalog.load(spark, sf_dir, "events").withColumnRenamed("event_type", "tool")
    base = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg((F.col("value") < 50).cast("double")), 9).alias("ok_rate"), F.max("value").alias("max_value"), F.countDistinct("user_id").alias("users"))
    return base.join(order_statistics(rows, ["tool"], "value", {"p95": (nearest_rank, 0.95)}).select("tool", "p95"), "tool")


@query("stream_sessions", f"WITH {_sessions_sql(21599)} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, count(*) AS n FROM g GROUP BY user_id, session_no".replace("> 21599000000", ">= 21600000000"))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the event log read as a stream, to the end of what is there."""
    schema = catalog.load(spark, sf_dir, "events").schema
    stream = streams.session_counts(streams.event_stream(spark, sf_dir, "events.parquet", schema), "user_id", "ts", "6 hours")
    out = streams.run_complete(stream, streams.scratch(spark, "sessions"), streams.scratch(spark, "offsets"))
    return out.select("user_id", F.date_format("start_ts", _TS).alias("start_ts"), "n")


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start_ts, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type of the event log read as a stream."""
    schema = catalog.load(spark, sf_dir, "events").schema
    stream = streams.window_counts(streams.event_stream(spark, sf_dir, "events.parquet", schema), "event_type", "ts", "1 hour")
    out = streams.run_complete(stream, streams.scratch(spark, "windows"), streams.scratch(spark, "offsets"))
    return out.select(F.date_format("start_ts", _TS).alias("start_ts"), "event_type", "n")
